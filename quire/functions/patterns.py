"""Regular expressions that read the same in Java and in RE2.

Java's ``\\s`` and ``\\w`` are ASCII, and its Unicode mode keeps combining marks
as word characters, so both classes are spelled out.
"""

SPACE_SET = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_SET}]"
SPACES = f"[{SPACE_SET}]+"
# Java matches a negated class of many ranges an order of magnitude slower than
# the complement written out, so the hot patterns list what they match.
NON_SPACES = (
    r"[!-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}\x{0}-\x{8}\x{e}-\x{1b}]+"
)
NON_ALPHANUMERICS = r"[\x{0}-/:-@\[-`{-\x{10ffff}]+"
NON_LETTERS = "[^a-zA-Z]+"
WORD_SET = r"\p{L}\p{N}_"
NEITHER_WORD_NOR_SPACE = f"[^{WORD_SET}{SPACE_SET}]"
WORDS_OF_TWO = f"[{WORD_SET}]{{2,}}"
LOWER_TOKENS = "[a-z']+"
INNER_PARENS = r"\([^()]*\)"
FLAT_PARENS = r"\([^)]*\)"
YEAR_START = "^([1-2][0-9]{3})"
DOI_PREFIX = r"^[^/\n]*/"
