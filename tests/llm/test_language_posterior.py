"""Language verdicts against the same fusion in plain Python, on the whole small table."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import language


def slots(text):
    data = (text or "").lower().encode()
    return [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(data) - 2)]


def softmax(logs):
    top = max(logs)
    powers = [math.exp(x - top) for x in logs]
    return [x / sum(powers) for x in powers]


def smoothed(counts, parent, weight):
    if counts is None:
        return parent
    return [(n + weight * p) / (sum(counts) + weight) for n, p in zip(counts, parent, strict=True)]


def brute(rows, labelled):
    """(id, text, declared, host) -> (language, confidence), every label's texts taken whole."""
    seen, total = defaultdict(Counter), Counter()
    for label, text in {(label, text) for label, text in labelled if label and len((text or "").encode()) >= 3}:
        found = slots(text)
        seen[label].update(found)
        total[label] += len(found)
    labels = sorted(seen)
    size = len(labels) + 1
    likelihoods = []
    for _, text, *_ in rows:
        found = Counter(slots(text))
        n = sum(found.values())
        if not n:
            likelihoods.append(None)
            continue
        sums = [
            sum(t * math.log((seen[x][s] + 0.1) / (total[x] + 0.1 * language.SLOTS)) for s, t in found.items()) for x in labels
        ]
        weight = language.TEMPER * min(n, language.FULL_TRIGRAMS) / n
        likelihoods.append([x * weight for x in (*sums, -n * math.log(language.SLOTS))])
    tables = [defaultdict(lambda: [0.0] * size) for _ in range(3)]
    for (_, _, declared, host), ll in zip(rows, likelihoods, strict=True):
        if ll is None:
            continue
        p = softmax(ll)
        for table, key in zip(tables, ("", declared, host), strict=True):
            if key is not None:
                table[key] = [a + b for a, b in zip(table[key], p, strict=True)]
    every = tables[0][""]
    world = [(n + 1) / (sum(every) + size) for n in every]
    out = []
    for (_, _, declared, host), ll in zip(rows, likelihoods, strict=True):
        if ll is None:
            out.append(("und", 0.0))
            continue
        prior = smoothed(tables[2].get(host), world, language.HOST_WEIGHT)
        said = smoothed(tables[1].get(declared), world, language.TABLE_WEIGHT)
        p = softmax([a + math.log(b) + math.log(c / w) for a, b, c, w in zip(ll, prior, said, world, strict=True)])
        best = max(range(size), key=lambda k: p[k])
        out.append(([*labels, "und"][best], p[best]))
    return out


def test_every_verdict_equals_plain_fusion(spark, sf_dir):
    given = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    given += [(-1, None, "en", "src0"), (-2, "", None, None), (-3, "xy", "de", None), (-4, "zq zq wvu wvu", None, "src1")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    found = language.identify(docs, language.fit(docs), declared=F.col("lang"), host=F.col("source")).collect()
    wanted = {row[0]: verdict for row, verdict in zip(given, brute(given, [(r[2], r[1]) for r in given]), strict=True)}
    assert len(found) == len(given)
    for r in found:
        name, confidence = wanted[r.doc_id]
        assert r.confidence == pytest.approx(confidence, abs=1e-5)
        assert r.language == name
        assert r.accepted == (name != "und" and confidence >= language.CONFIDENCE)


def test_rows_of_one_id_and_text_have_verdicts_of_their_own(spark):
    """One text that fits no language well, with and without evidence."""
    words = {"en": "the and with from", "xx": "zorb klim plox vrut"}
    rows = [(100 + k, f"{words[x]} {k}", x, f"host {x}") for x in words for k in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, host string"))
    both = [(3, "the zorb", None, None, 1), (3, "the zorb", "en", "host en", 2), (3, None, "en", "host en", 3)]
    table = spark.createDataFrame(
        [(*r, 0) for r in rows] + both, "doc_id long, text string, lang string, host string, place int"
    )
    evidence = {"declared": F.col("lang"), "host": F.col("host")}
    verdicts = language.identify(table, model, **evidence).where("doc_id = 3").collect()
    assert len({r.print for r in verdicts}) == 3
    kept = language.accepted(table, model, **evidence).where("doc_id = 3").collect()
    wanted = sum(r.accepted for r in verdicts)
    assert len(kept) == wanted and all(r.text is not None for r in kept)
    assert 2 in {r.place for r in kept}
