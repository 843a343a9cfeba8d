"""The audit of sources against a plain computation."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from probanza.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value string"


def _plain(rows, top=200):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in seen.items() if n >= 3}
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s in counts:
            pairs = [(sum((share(counts[s], w) - share(counts[o], w)) ** 2 // share(counts[o], w) for w in kept), o) for o in counts if o != s]
            ahead = [((share(counts[s], w) - share(whole, w)) ** 2 // share(whole, w), w) for w in counts[s] if share(counts[s], w) > share(whole, w)]
            for part, found in (("pair", pairs), ("term", ahead)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, s, 5, "x", "y") for t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = ["a", "Bb", "éa", "ABCDEFGH", "abcdefghi", "sixteen" * 2 + "ab", "seventeen" * 2, "日本語日本語", "ÀB", "x" * 300, "it", "z", "Zz", "long" * 9, "long" * 8 + "lonh"]
    out = []
    for _ in range(150):
        text = "".join(w + str(rng.choice([" ", "\n", "1", "-", "\x00", "_", "["])) for w in rng.choice(words, rng.integers(0, 30)))
        out.append((text, ["en", "de", None][rng.integers(0, 3)], ["s1", "s2", "s\x003", "", None, "t"][rng.integers(0, 6)]))
    out += [(None, "en", "none"), ("", "fr", "only"), ("1 2 3", "fr", None), ("rare words here", "xx", "p"), ("q" * 200_000 + " a", "en", "s1")]
    return out + [out[7]] * 30


def test_audit(spark, rows):
    df = divergence.audit(_frame(spark, rows))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, df.collect()))
    assert got == _plain(rows) and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_audit_in_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 40)
    assert sorted(map(tuple, divergence.audit(_frame(spark, rows).repartition(3)).collect())) == _plain(rows)


def test_audit_ranks_and_empty_table(spark):
    rows = [(" ".join(chr(97 + k // 26) + chr(97 + k % 26) for k in range(400)), "en", "a")] * 3 + [("aa ab", "en", "b")] * 3
    assert sorted(map(tuple, divergence.audit(_frame(spark, rows)).collect())) == _plain(rows)
    assert divergence.audit(_frame(spark, rows).limit(0)).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 1 << 63, 2000, dtype=np.uint64) % np.uint64(m) for m in (3, 1 << 40)]
    words[1][::2] = 7
    assert divergence.radix_order(words).tolist() == np.lexsort((words[1], words[0])).tolist()
    assert divergence.radix_order([np.zeros(0, np.uint64)]).tolist() == []


def test_packed_words_sort_as_bytes():
    terms = [b"a", b"ab", b"abcdefgh", b"\xc3\xa9", b"abcdefghi", b"abcdefghz", b"zzzzzzzzzzzzzzzz"]
    data = np.frombuffer(b"".join(terms) + bytes(16), dtype=np.uint8)
    start = np.cumsum([0, *map(len, terms)])[:-1]
    words = divergence.packed_words(data, start, np.array([*map(len, terms)]), 2)
    assert [terms[i] for i in divergence.radix_order(words)] == sorted(terms)
