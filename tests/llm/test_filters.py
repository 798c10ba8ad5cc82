"""Decontamination, line dedup and language identification."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, language, lines

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for p in range(len(w) - size + 1):
            if size:
                windows[tuple(w[p : p + size])].add(str(item))
    out = {}
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                k = tuple(w[p : p + size])
                if k in windows:
                    hit.update(range(p, p + size))
                    found |= windows[k]
        out[i, text or ""] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("broadcast", [0, decontaminate.BROADCAST_WINDOWS])
def test_windows_hits_and_items(spark, docs_of, odd, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    items = [(1, LONG), (2, "Short Item"), (3, None), (4, " - "), (10, "short, item"), (5, LONG + " x"), (6, "é")]
    rows = [
        *odd,
        (20, LONG.upper().replace(" ", "--")),
        (21, "short item short item " + "clean " * 200),
        (22, "short item " + "clean " * 38),
        (23, "short item " + "clean " * 39),
        (24, " ".join(LONG.split()[1:]) + " " + LONG),
        (25, "É é"),
        (26, "three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    ]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs_of(rows), df).collect()
    wanted = hits(rows, items)
    assert len(got) == len(wanted)
    assert sorted(
        ((r.doc_id, r.n_words, r.n_hit, list(r.found_items), r.contaminated) for r in got), key=repr
    ) == sorted(((i, *v) for (i, _), v in wanted.items()), key=repr)
    kept = decontaminate.clean(docs_of(rows), df)
    assert kept.columns == docs_of(rows).columns
    stay = Counter(r for r in rows if not wanted[r[0], r[1] or ""][3])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == stay


@pytest.mark.parametrize("broadcast", [0, decontaminate.BROADCAST_WINDOWS])
def test_items_without_an_id_hit(spark, docs_of, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    items = spark.createDataFrame([(None, LONG), (None, "short item"), (7, "short item")], "item_id long, text string")
    rows = [(1, LONG), (2, "a short item"), (3, "clean")]
    got = {r.doc_id: r for r in decontaminate.report(docs_of(rows), items).collect()}
    assert {i: (r.n_hit, list(r.found_items), r.contaminated) for i, r in got.items()} == {
        1: (14, [], True), 2: (2, ["7"], True), 3: (0, [], False)
    }
    assert [r.doc_id for r in decontaminate.clean(docs_of(rows), items).collect()] == [3]


def test_no_items_and_no_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.report(docs_of([(1, LONG)]), none).collect()] == [False]
    some = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert decontaminate.report(docs_of([(1, LONG)]).limit(0), some).count() == 0


def site_docs(spark):
    """Lines on 9, 10 and 25 sites, a line often repeated on one site, odd rows."""
    rows, texts = [], []
    for s in range(25):
        body = [f"own line {s}", "  everywhere  "]
        if s < 10:
            body.append("on ten")
        if s < 9:
            body.append("on nine")
        texts.append((s, "\n".join(body), f"site{s}"))
    texts += [(100 + k, "only here\n\n \neverywhere", "site0") for k in range(40)]
    texts += [(200, None, "site1"), (201, "", "site1"), (202, "on ten", None), (None, "everywhere", "x"), (203, " ", None)]
    texts += texts[:2]
    for i, t, s in texts:
        rows.append((i, t, s, 5))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int"), texts


@pytest.mark.parametrize("sent", [0, common.SENT_KEYS])
def test_lines_on_many_sites_go(spark, sent, monkeypatch):
    monkeypatch.setattr(lines, "SENT_KEYS", sent)
    df, texts = site_docs(spark)
    sites = defaultdict(set)
    for _, t, s in texts:
        for x in (t or "").split("\n"):
            if x.strip():
                sites[x.strip()].add(s)
    wanted = Counter()
    for i, t, s in texts:
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip()]) < 10)
        wanted[i, t, s, 5] += 1
    got = lines.removed(df)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == wanted


def test_only_uncertain_lines_are_counted_exactly(spark):
    df, _ = site_docs(spark)
    found = {r.h: (r.sites, r.exact) for r in lines.spread(df).collect()}
    assert sorted(found.values()) == [(11, True), (26, False)]
    assert lines.removed(df.limit(0)).count() == 0


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = language.fit(docs.where(half))
    held = docs.where(~half)
    found = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in found) >= 0.97 * len(found)


def test_evidence_moves_a_text_that_fits_two_languages(spark):
    rows = [(k, "aaa bbb ccc", "xx") for k in range(40)] + [(100 + k, "aaa bbb ddd", "yy") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    seen = [(k, "aaa bbb ccc", "xx", "h1.a.org", "org") for k in range(60)]
    seen += [(100 + k, "aaa bbb ddd", "yy", "h2.b.net", "net") for k in range(60)]
    seen += [(500, "aaa bbb", "xx", "h1.a.org", "org"), (501, "aaa bbb", "yy", "h2.b.net", "net")]
    seen += [(502, "aaa bbb", None, None, None), (503, None, "xx", "h1.a.org", "org"), (504, "☃☃☃☃☃☃☃☃", "", "h1.a.org", "")]
    pages = spark.createDataFrame(seen, "doc_id long, text string, d string, h string, s string")
    got = {
        r.doc_id: r
        for r in language.identify(
            pages, model, declared=F.col("d"), host=F.col("h"), suffix=F.col("s"), domain=F.col("s")
        ).collect()
    }
    assert len(got) == len(seen)
    assert got[500].language == "xx" and got[501].language == "yy"
    assert got[500].confidence > got[502].confidence
    assert not got[503].accepted and got[503].language == "und"
    kept = language.accepted(pages, model=model, declared=F.col("d"), host=F.col("h"))
    assert kept.columns == pages.columns and {503} & {r.doc_id for r in kept.collect()} == set()


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc def", None), (2, None, None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {(r.language, r.accepted) for r in language.identify(docs, model).collect()} == {("und", False)}
    assert language.identify(docs.limit(0), model, host=F.col("lang")).count() == 0


def own_words(label, k):
    """A text of words that only one label has."""
    return " ".join(f"{label}{chr(97 + (k + j) % 26)}{label}" for j in range(20))


def test_a_rare_language_of_a_large_table_is_a_class(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 60)
    monkeypatch.setattr(language, "LABEL_ROWS", 10, raising=False)
    rows = [(k, f"{own_words('abc', k)} {k}", "aa") for k in range(3000)]
    rows += [(5000 + k, f"{own_words('xyz', k)} {k}", "rare") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs)
    assert model[0] == ["aa", "rare"]
    got = language.identify(docs, model, declared=F.col("lang")).collect()
    assert all(r.accepted and r.language == ("rare" if r.doc_id >= 5000 else "aa") for r in got)


def test_copies_of_a_text_count_once(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 40)
    monkeypatch.setattr(language, "LABEL_ROWS", 10, raising=False)
    rows = [(k, f"{own_words('abc', k)} {k}", "aa") for k in range(200)]
    copies = [(1000 + k, text, "aa") for _, text, _ in rows[:100] for k in range(5)]
    one, more = (
        language.fit(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(3))
        for x in (rows, rows + copies)
    )
    assert one[0] == more[0] and all((a == b).all() for a, b in zip(one[1], more[1], strict=True))


def test_more_than_two_hundred_languages(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmno" for b in "pqrstuvwxyzabcd"]
    rows = [(10 * i + k, own_words(name + "q" + name[::-1], k), name) for i, name in enumerate(names) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model[0] == sorted(names) and len(names) == 225
    got = language.identify(docs, model, declared=F.col("lang"), host=F.col("lang")).collect()
    assert all(r.accepted and r.language == names[r.doc_id // 10] for r in got) and len(got) == len(rows)


def test_address_and_markup(spark):
    row = spark.createDataFrame(
        [("https://u@Blog.Example.co.uk:80/x?y=http://z.org", '<html class="a" LANG=\'de-AT\'><script>x<y</script><p>Hi&amp;<!-- no --></p>')],
        "url string, html string",
    )
    parts = language.address(F.col("url"))
    got = row.select(
        *[c.alias(k) for k, c in parts.items()],
        language.declared_in(F.col("html")).alias("d"),
        F.trim(language.visible_text(F.col("html"))).alias("t"),
    ).first()
    assert (got.host, got.domain, got.suffix) == ("blog.example.co.uk", "co.uk", "uk")
    assert got.d.lower() == "de" and got.t == "Hi"
