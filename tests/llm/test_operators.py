"""Every operator against a plain computation, and on null, empty, long, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probanza.llm import (
    fingerprint,
    language_id,
    licenses,
    mixing,
    near_duplicates,
    packing,
    quality,
    token_counts,
    token_output,
    url_filter,
)
from probanza.llm.encode import Encoder
from probanza.llm.queries import URL_RULES

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank while many small birds sing in tall green trees"
_COUNTER = token_counts.PieceCounter(BYTES, public_tokenizers.PATTERN, {})
#: Columns that share names with results and helpers of the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, score double, n_words long, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "\n\n", "a", SENTENCE, SENTENCE, SENTENCE + ".", "Ünïcode <|endoftext|> ab", "x " * 60_000, "日本語 текст\t\tend "]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", 0, "r", "k", 0.5, 7, "i") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, SENTENCE, "en", "s", 0, "r", "k", 0.5, 7, "i")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def _ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    rng, parts = np.random.default_rng(4), ["a", "Bc", " ", "\n", "  ", "\t", "!!", "'s", "'", "é", "İ", "9", "²", "<|endoftext|>", "中", "́", "\xa0", "foo,"]
    worker = Encoder(path)
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(worker.ids32(text), "<u4").tolist() == worker.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cache_is_bounded():
    from probanza.llm.texts import Cache

    cache = Cache(len, {"fixed": 5}, entries=10)
    assert [cache[str(i)] for i in range(1000)] == [len(str(i)) for i in range(1000)]
    assert len(cache) <= 12 and len(cache.old) <= 12 and cache["fixed"] == 5


@pytest.mark.parametrize("hot", [1, 1000])
def test_token_counts(odd, hot):
    got = token_counts.token_counts(odd, BYTES, public_tokenizers.PATTERN, limit=30, hot_size=hot).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(_ids(BYTES, r["text"]))) for r in odd.collect()]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 30) for r in got)


def test_token_counts_of_long_pre_tokens(spark):
    texts = [" " * 300_000, "\n" * 300_000, "a" * 300_000, "7" * 300_000, "a b " + " " * 70_000 + "c", "ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all(len(p) <= token_counts.LONGEST for p in token_counts.frequent_pieces(docs, BYTES, public_tokenizers.PATTERN))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(_ids(BYTES, t)) for i, t in enumerate(texts)}


_SCRIPTS = ["“the” cat — it’s", "съешь же ещё этих мягких булок", "日本語の文 です。\n中文 文字", "αβγ\u00a0δ  ε\u3000 ζ\x85 η", "٣٤ 7７ e\u0301x", "a\u200b b\u2028 c\x1c d"]


@given(st.lists(st.sampled_from([*" \n\ta'sé7.ж日’٣\u00a0\u3000\x85\u200b\u2028\x1c\u0301\U0001f600", "  ", "’s"]), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_pieces_of_any_script_add_up(text):
    assert _COUNTER.count(text) == len(_COUNTER.tokenizer.encode(text, add_special_tokens=False).ids)


def test_other_scripts_go_through_the_table(spark):
    texts = [t for t in _SCRIPTS for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequent = token_counts.frequent_pieces(docs, BYTES, public_tokenizers.PATTERN)
    assert {" булок", "съешь", " —", "“the”", " cat", "\n中文"} <= set(frequent)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(_ids(BYTES, t)) for i, t in enumerate(texts)}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.predict(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(odd):
    got = language_id.predict(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by_id[0] == by_id[1] == by_id[3] == "und" and by_id[5] == by_id[10] == "en"
    assert {r["lang_pred"] for r in language_id.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bit_sliced_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    profiles = {f"l{k:02d}": rng.integers(0, 1 << 62, 500).astype(np.uint64) for k in range(70)}
    model = language_id.BitSlicedFilter(profiles)
    for k, name in enumerate(model.languages):
        mask = model.masks(profiles[name])[k // model.width]
        assert ((mask >> mask.dtype.type(k % model.width)) & mask.dtype.type(1)).all()


def _plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


def test_url_filter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    extra = [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "http://A.EXAMPLE.com/en/x?y://z"), (9005, "http://com"), (9006, "http://notcom/"), (None, "x://www.example.com/en/é"), (9004, "http://h\n.com/a\nb")]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string"))
    got = url_filter.url_filter(pages, URL_RULES).collect()
    want = [(r["page_id"], *_plain_url(r["url"])) for r in pages.collect()]
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"]) for r in got))) == sorted(map(str, want))
    assert all(r["verdict"] == URL_RULES[r["rule"]] for r in got if r["rule"])
    empty = url_filter.url_filter(pages.limit(0), URL_RULES)
    assert empty.count() == 0


def test_url_models_equal_plain_dictionaries(spark):
    """Scores of varied, repeated, long and odd URLs, and the verdicts that follow from them."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-_/é"))
    urls = ["http://" + "".join(rng.choice(letters, 12)) + f".{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/" + "".join(rng.choice(letters, 9)) for _ in range(3000)]
    urls += [urls[7]] * 700 + [None, "", "\0", "a", "http://x.org/" + "ab/" * 20_000]
    rows = [(i, u, "h", "p", 0.5, 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, score double, h1 long").repartition(5)
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    models = {"allow": [{} for _ in range(6)], "block": [{} for _ in range(6)]}

    def grams(url):
        symbols = (*[None] * 5, *url.encode())
        return [[symbols[j - k : j + 1] for k in range(6)] for j in range(5, len(symbols))]

    for u in urls:
        rule = _plain_url(u)[2]
        if rule and zlib.crc32(u.encode()) % 4 != url_filter.FOLD:
            for gram in grams(u):
                for k, g in enumerate(gram):
                    own = models[URL_RULES[rule]][k].setdefault(g[:-1], {})
                    own[g[-1]] = own.get(g[-1], 0) + 1
    totals = {name: [{c: sum(own.values()) for c, own in level.items()} for level in model] for name, model in models.items()}
    for i in [*range(0, 3000, 50), *range(3695, len(urls))]:
        total, all_grams = 0.0, grams(urls[i] or "")
        for gram in all_grams:
            for name, sign in (("allow", 1), ("block", -1)):
                p = 1 / 256
                for k, g in enumerate(gram):
                    seen = models[name][k].get(g[:-1], {})
                    p = (seen.get(g[-1], 0) + 4 * p) / (totals[name][k].get(g[:-1], 0) + 4)
                total += sign * np.log(p)
        assert abs(got[i]["score"] - total / max(1, len(all_grams))) < 1e-8, urls[i]
        want = URL_RULES.get(_plain_url(urls[i])[2]) or ("allow" if got[i]["allowed_probability"] >= 0.5 else "block")
        assert got[i]["verdict"] == want


def test_url_models_on_the_fold_they_never_saw(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    fold = {r["page_id"] for r in pages.collect() if zlib.crc32(r["url"].encode()) % 4 == url_filter.FOLD}
    known = [r for r in url_filter.url_filter(pages, URL_RULES).collect() if r["rule"] and r["page_id"] in fold]
    assert len(known) > 100 and np.mean([(r["allowed_probability"] >= 0.5) == (r["verdict"] == "allow") for r in known]) > 0.95


def test_url_plans_hold_one_level_each(spark, monkeypatch):
    """The driver keeps threads and plans for the exchanges of a query: they must not grow with the levels of the models."""
    exchanges, plain = {}, url_filter.stored

    def noted(df, label):
        exchanges[label] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return plain(df, label)

    monkeypatch.setattr(url_filter, "stored", noted)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    result = url_filter.url_filter(pages, URL_RULES)
    noted(result, "result")
    assert max(exchanges.values()) <= 10 and sum(exchanges.values()) <= 40, exchanges


def test_url_calibration_weighs_every_page(spark):
    """Repeated URLs of the fold count as often as they occur, and pages of other folds or without a rule do not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    often = pages.filter("url LIKE '%.com/%'").limit(20).withColumn("page_id", F.explode(F.sequence(F.lit(100_000), F.lit(100_040))))
    got = url_filter.url_filter(pages.unionByName(often).unionByName(spark.createDataFrame([(-1, None), (-2, "")], pages.schema)), URL_RULES).collect()
    urls = {r["page_id"]: r["url"] or "" for r in pages.collect()}
    held = [r for r in got if r["rule"] and zlib.crc32(urls.get(r["page_id"], "").encode()) % 4 == url_filter.FOLD and r["page_id"] < 100_000]
    again = {r["url"] for r in often.collect()}
    weight = [1.0 + 41 * (urls[r["page_id"]] in again) for r in held]
    slope, offset = url_filter._logistic(np.array([round(r["score"], 2) for r in held]), np.array([r["verdict"] == "allow" for r in held]), np.array(weight))
    for r in got:
        assert abs(1 / (1 + np.exp(-(slope * r["score"] + offset))) - r["allowed_probability"]) < 1e-6


def _plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_measures(odd, docs):
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    got = quality.quality(rows).collect()
    want = [(r["doc_id"], *_plain_quality(r["text"])) for r in rows.collect()]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got))) == sorted(map(str, want))
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"]) and sum(r["kept"] for r in got) > 100
    assert quality.quality(odd.limit(0)).count() == 0


def test_fingerprints(odd, docs):
    rows = docs.select("doc_id", "text").unionByName(odd.select((odd.doc_id + 100_000).alias("doc_id"), "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    order = sorted(rows.collect(), key=lambda r: -r["doc_id"])
    by_text = {}
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = r["text"] or "", after["text"] or ""
        cut = len(text) // 3
        own = got[r["doc_id"]]
        assert own["n_chars"] == len(text)
        assert own["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
        assert by_text.setdefault(text, own["fingerprint"]) == own["fingerprint"]
        assert 0 <= own["near_next"] <= 1 and (text != following or own["near_next"] == 1)
    long = [got[r["doc_id"]]["near_edited"] for r in order if len(r["text"] or "") > 2000]
    assert 0.45 < np.mean(long) < 0.85
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(odd.limit(0)).count() == 0


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _plain_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return _signed(h)


def _plain_anchors(text):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    inner = [_plain_hash(words[i : i + 2]) for i in range(len(words) - 1)]
    found = [
        (i, _plain_hash(words[i : i + 5])) for i in range(len(words) - 4)
        if min(inner[i], inner[i + 3]) <= min(inner[i + 1 : i + 3])
    ]
    return found or [(0, _plain_hash([text]))]


def _plain_likeness(a, b):
    places = [defaultdict(list), defaultdict(list)]
    for side, anchors in zip(places, (a, b), strict=True):
        for p, h in anchors:
            side[h].append(p)
    pairs = sorted(pair for h, ps in places[0].items() for pair in zip(ps, places[1][h], strict=False))
    kept = sum(k == 0 or y > pairs[k - 1][1] for k, (_, y) in enumerate(pairs))
    share = kept / (len(a) + len(b) - len(pairs))
    return 2 * share / (1 + share)


def test_anchors_and_likeness_equal_plain_ones(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice("abcdefghijklmnopqrstuvw") + str(k) for k in range(60))
    texts = [passage, "\n".join([passage] * 40), "a b " * 500, "", "one two", "é" * 3 + " b c d e", None]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(300))) for _ in range(30)]
    rows = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 3
        own, edited, following = map(_plain_anchors, (text, text[: len(text) - cut] + after[:cut], after))
        row = got[-i]
        for column, anchors in (("fingerprint", own), ("edited_fingerprint", edited)):
            assert row[column] == " ".join(f"{p}:{h % (1 << 64):x}" for p, h in anchors)
        assert row["near_edited"] == pytest.approx(_plain_likeness(own, edited))
        assert row["near_next"] == pytest.approx(_plain_likeness(own, following))
    assert got[0]["near_next"] < 0.06  # once against forty times


def test_shared_passage_shows_in_long_fingerprints(spark):
    passage = [f"p{k}" for k in range(200)]
    texts = [[f"{s}{k}" for k in range(n)] for s, n in (("a", 20_000), ("b", 20_000))]
    texts = [t[:c] + passage + t[c:] for t, c in zip(texts, (3_000, 11_000), strict=True)] + [passage]
    rows = spark.createDataFrame([(3 - i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    anchors = {i: [x.split(":") for x in r["fingerprint"].split()] for i, r in got.items()}
    inside = {h for _, h in anchors[1]}
    assert len(inside) > 50
    for i, cut in ((3, 3_000), (2, 11_000)):
        assert inside == {h for p, h in anchors[i] if cut <= int(p) <= cut + 195}
    sets = {i: {h for _, h in a} for i, a in anchors.items()}
    for i, j in ((3, 2), (2, 1)):
        share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(got[i]["near_next"] - 2 * share / (1 + share)) < 0.001 and share > 0


def test_license_scan(spark, docs):
    rows = docs.select("doc_id", "text")
    extra = [(90_001, "about\n\nReleased under the MIT License.\nend"), (90_002, None), (90_003, ""), (90_004, "a driver with a license to drive a car in the city")]
    rows = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    model = licenses.train(rows)
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(rows, model).collect() if r["confirmed"]}
    signs = {"Apache License": "apache-2.0", "MIT License": "mit", "CC BY-NC": "cc-by-nc", "General Public": "gpl"}
    want = {
        (r["doc_id"], k): family for r in rows.collect() for k, line in enumerate((r["text"] or "").split("\n"))
        for sign, family in signs.items() if sign in line
    }
    assert want.items() <= got.items() and (90_001, 2) in got and not any(d == 90_004 for d, _ in got)
    assert licenses.scan(rows.limit(0), model).count() == 0


def test_notices_of_unlisted_licences_are_unknown(spark, docs):
    texts = ["Released under the ISC License.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Artistic License 2.0."]
    texts += ["Released under the MIT License.", "a driver with a license to drive a car in the city"]
    rows = spark.createDataFrame([(i, f"about\n{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licenses.scan(rows, licenses.train(docs)).collect()}
    assert got == {(0, 1): ("unknown", False), (1, 1): ("unknown", False), (2, 1): ("unknown", False), (3, 1): ("mit", True)}


def _schedule(spark, weights, length, frame):
    """(source, block) by slot for ``length`` slots in which no source ends."""
    names = [f"={i:04}" for i in range(len(weights))]
    blocks = [int(w / sum(weights) * length) + 2 for w in weights]
    plan = mixing.epochs(names, mixing.units(weights, sum(blocks)), blocks, frame)
    rows = mixing.scheduled(spark, plan, frame).collect()
    assert sorted((r["s2"], r["k2"]) for r in rows) == [(n, k) for n, b in zip(names, blocks, strict=True) for k in range(b)]
    assert len({r["slot"] for r in rows}) == len(rows)
    return [(names.index(r["s2"]), r["k2"]) for r in sorted(rows, key=lambda r: r["slot"])][:length]


@pytest.mark.parametrize(
    ("weights", "frames", "frame"),
    [
        ([1, 1], 5, 64), ([5, 3, 2], 20, 64), ([0.37, 0.21, 0.4, 0.02], 100, 64), ([1] * 40, 8, 64), ([0.9, *[0.001] * 100], 30, 64),
        ([2**0.5, 3**0.5, 5**0.5, 0.01, 1e-7], 100, 32), ([0.5, *[0.5 / 899] * 899], 4, 1024),
    ],
)
def test_schedule_deviates_less_than_a_block(spark, weights, frames, frame):
    """Against the given weights, over many frames and many sources."""
    got, whole = _schedule(spark, weights, frames * frame, frame), sum(weights)
    share, seen = np.array(weights) / whole, np.zeros(len(weights), dtype=np.int64)
    for t, (source, block) in enumerate(got, start=1):
        assert block == seen[source]
        seen[source] += 1
        assert np.abs(seen - share * t).max() < 1 + 1e-9, t  # the plain product in double precision


def test_two_thousand_sources(spark):
    weights = [0.5, *[0.5 / 1999] * 1999]
    seen = np.bincount([s for s, _ in _schedule(spark, weights, 2000, 1024)], minlength=2000)
    assert np.abs(seen - np.array(weights) * 2000).max() < 1


def test_frames_end_where_a_plain_schedule_can_follow():
    """The counts at the end of every frame leave all windows of both neighbours open, for random weights."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = [int(x) for x in rng.integers(1, 10 ** int(rng.integers(1, 7)), size=int(rng.integers(2, 30)))]
        whole, frame, low = sum(a), 32, [0] * len(a)
        for f in range(12):
            high = mixing.had_by(a, (f + 1) * frame, frame)
            todo = {(i, k) for i in range(len(a)) for k in range(low[i], high[i])}
            assert len(todo) == frame
            for t in range(f * frame, (f + 1) * frame):
                due, i, k = min((-(-(k + 1) * whole // a[i]), i, k) for i, k in todo if k * whole // a[i] <= t)
                assert t < due
                todo.remove((i, k))
            low = high


def test_mixing(spark, odd, docs):
    rows = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    got = mixing.mixed(rows, {"src0": 0.5}, block_docs=4).collect()
    assert sorted(map(str, (tuple(r["row"]) for r in got))) == sorted(map(str, map(tuple, rows.collect())))
    places = {(r["slot"], r["place"]) for r in got}
    assert len(places) == len(got) and len({(r["slot"], r["row"]["source"]) for r in got}) == len({r["slot"] for r in got})
    assert mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.mixing_report(odd).count() == odd.count()


def test_packing(odd, docs):
    rows = docs.select("doc_id", "text").unionByName(odd.select((odd.doc_id + 100_000).alias("doc_id"), "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    got = packing.packing_report(packing.packed(rows, WORDS, 2)).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0 and {r["sequence_length"] for r in own} == {at}
    for r in rows.collect():
        ids, at = [*_ids(WORDS, r["text"]), 2], 0
        for p in sorted(pieces.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == _crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not pieces and packing.packed(odd.limit(0), WORDS, 2).count() == 0


def test_packing_carries_rests_between_groups():
    packer, rng = packing.Packer(0, window=64, group=500, step=256), np.random.default_rng(2)
    total, batches = 0, []
    for k in range(200):
        n = int(rng.integers(1, 150))
        total += n
        packer.add(k, b"\0" * 4 * n)
        if packer.tokens >= packer.group:
            batches += packer.flush(last=False)
    batches += packer.flush(last=True)
    rows = [r for b in batches for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == total and all(r["sequence_length"] & (r["sequence_length"] - 1) == 0 for r in rows)


def _plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _check_join(rows, got):
    by_set, sets = {}, {}
    for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        sets[r["doc_id"]] = by_set.setdefault(_plain_set(r["text"]), r["doc_id"])
    of = {c: s for s, c in by_set.items()}
    near = {c: {d for d in of if d != c and of[c] and len(of[c] & of[d]) >= 0.8 * len(of[c] | of[d])} for c in of}
    for r in got:
        if r["doc_id"] is None:
            continue
        own = sets[r["doc_id"]]
        assert r["class_id"] == own and r["n_links"] == len(near[own])
        group, todo = {own}, [own]
        while todo:
            fresh = near[todo.pop()] - group
            group |= fresh
            todo += fresh
        assert r["group_id"] == min(group)


def _variants(n):
    words = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        own = words.copy()
        own[(7 * k) % 400] = f"x{k}"
        out.append((10_000 + k, " ".join(own)))
    return out


def test_similarity_join(spark, odd, docs):
    rows = docs.select("doc_id", "text").unionByName(odd.select((odd.doc_id + 100_000).alias("doc_id"), "text"))
    rows = rows.unionByName(spark.createDataFrame(_variants(150), "doc_id long, text string"))
    got = near_duplicates.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    _check_join(rows.collect(), got)
    assert max(r["n_links"] for r in got) == 149  # several blocks of one family
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0


def test_links_of_few_long_texts_count_once(spark):
    rows = []
    for n in (2, 3, 4, 5):
        words = [f"f{n}w{k}" for k in range(72_000)]
        for k in range(n):
            own = words.copy()
            own[1_000 * (k + 1)] = f"x{k}"
            rows.append((100 * n + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_links"], r["group_id"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: (i // 100 - 1, i // 100 * 100) for i, _ in rows}


def test_bands_reach_the_recall():
    rows, bands = near_duplicates.plan_bands(0.8, 0.999, 320)
    assert rows * bands <= 320 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_one_per_group(spark, odd):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are in this one text"), (3, "other words are in this one text"), (4, None), (None, "x y")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in near_duplicates.one_per_group(rows).collect())))
    assert got == sorted(map(str, [(1, "a b c d e f"), (3, "other words are in this one text"), (4, None), (None, "x y")]))
    assert near_duplicates.one_per_group(odd).columns == odd.columns


@pytest.mark.parametrize("top", [1, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1])
def test_stream_round_trip(top):
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1003):
        ranks = rng.integers(0, top + 1, n, dtype=np.uint64).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 3))
        lengths = np.diff(cuts, prepend=0, append=n)
        streams = token_output.encode_ranks(ranks, lengths)
        sizes = np.array([len(x) for x in streams])
        assert (token_output.decode_ranks(np.frombuffer(b"".join(streams), np.uint8), sizes, lengths) == ranks).all()
        for stream, part in zip(streams, np.split(ranks, cuts), strict=True):
            assert (token_output.decode_ranks(np.frombuffer(stream, np.uint8), np.array([len(stream)]), np.array([len(part)])) == part).all()


def test_token_output(odd, docs):
    rows = docs.select("doc_id", "text").unionByName(odd.select((odd.doc_id + 100_000).alias("doc_id"), "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    got, at = {r["doc_id"]: r for r in token_output.round_trip(rows, BYTES, 2).collect()}, 0
    for r in sorted(rows.collect(), key=lambda r: r["doc_id"]):
        ids = [*_ids(BYTES, r["text"]), 2]
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), _crc(ids))
        at += len(ids)
    assert token_output.round_trip(odd, BYTES, 2).count() == odd.count()
    assert token_output.round_trip(odd.limit(0), BYTES, 2).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and len({r["doc_id"] for r in got}) > 100


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "").collect()
        stage(spark, odd.limit(0), "").collect()
