"""Work that is done for many texts at once, against the same work one by one, and sketches against exact quantiles."""

import random

import numpy as np
import pytest

from keyloom.llm import bpe, license_scan, partenum, quality, simhash, words
from keyloom.llm.workspace import Workspace

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_together_agrees_with_the_library(monkeypatch):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"abctheion \xc3\xa9\xff") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    pieces += [rng.choice([b"a", b"th", b"ing", b"\xff"]) * rng.randrange(1, 30) for _ in range(500)] + pieces[:20]
    want = [library._encode_single_piece(p) for p in pieces]
    pairs = bpe.BytePairs(ranks)
    for many in (1, 10**9):
        monkeypatch.setattr(bpe, "MANY", many)
        assert [np.frombuffer(x, np.uint32).tolist() for x in pairs.encode_all(pieces)] == want
    assert pairs.encode_all([]) == []


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 2, 5, 11, 12, 40, 300, 0, 3000, 7)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    features = np.concatenate(sets)
    frequent = np.sort(rng.choice(features, len(features) // 3, replace=False))
    bands = partenum.Bands(75)
    for known in (frequent, frequent[:0]):
        sig, owner = partenum.set_signatures(features, at, bands, known)
        for i, s in enumerate(sets):
            assert sorted(sig[owner == i].tolist()) == sorted(partenum.signatures(s, bands, known).tolist())


def test_shingle_sets_of_chunks_are_those_of_each_text(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", "a", "A b", " ", *(" ".join(rng.choice("abcdef") for _ in range(n)) for n in (4, 5, 6, 60, 2, 300)), "", "x y z x y z"]
    want = [s.tolist() for t in texts for s in words.shingle_sets(pa.array([t], pa.large_string()))]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(words, "CHUNK_BYTES", size)
        assert [s.tolist() for s in words.shingle_sets(pa.array(texts, pa.large_string()))] == want


def test_fences_lie_at_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lang, source, n, scale in (("en", "a", 400, 1.0), ("en", "b", 400, 3.0), ("de", "a", 300, 2.0)):
        for _ in range(n):
            size = int(rng.integers(60, 200))
            rows.append((lang, source, size, int(rng.poisson(5 * size * scale)), int(rng.poisson(scale)), 0, 0, int(rng.integers(3, 9)), int(rng.poisson(4 * scale)), 0))
    names = ["lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]
    counted = spark.createDataFrame(rows, ", ".join(f"keyloom_{c} {'string' if i < 2 else 'long'}" for i, c in enumerate(names)))
    data = {c: np.array([r[i] for r in rows]) for i, c in enumerate(names)}
    w = data["n_words"].astype(float)
    ratios = {"symbol_ratio": data["n_symbols"] / w, "dup_line_ratio": 0 * w, "repeat_ratio": 0 * w, "upper_ratio": data["n_upper"] / data["word_chars"], "shout_ratio": 0 * w, "word_chars_mean": data["word_chars"] / w}
    q = lambda x, rank: np.quantile(x, min(1, max(0, rank)), method="nearest")
    found = quality.fences(Workspace(spark, "t").write(quality.sketches(counted), "sketches")).collect()
    assert len(found) == 3
    seen = set()
    for r in found:
        group = (data["lang"] == r.fence_lang) & (data["source"] == r.fence_source)
        for name, x in ratios.items():
            ends = []
            for e in (-0.03, 0.03):  # twice a sketch's rank error
                length = {c: q(data[c][group], 0.5 - e) for c in quality.LENGTHS}
                once = 1 / length["n_words"]
                least = {"symbol_ratio": once, "dup_line_ratio": 1 / length["n_lines"], "repeat_ratio": 6 * once, "upper_ratio": 1 / length["word_chars"], "shout_ratio": once, "word_chars_mean": q(x[group], 0.5 + e) * once}[name]
                high = q(x[group], quality.HIGH + e)
                ends.append(high + quality.SPREADS * max(least, high - q(x[group], 0.5 - e)))
            fence = r[f"fence_{name}"]
            assert ends[0] * 0.999 <= fence <= ends[1] * 1.001, (name, ends, fence)
            seen.add((name, round(fence, 9)))
    assert len({v for n, v in seen if n == "symbol_ratio"}) == 3


def test_licenses_in_a_long_text_of_licenses(spark):
    full, rng = license_scan.TEMPLATES, random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    body = " ".join([full["MIT-full"], full["ISC-full"], filler(500)] * 10 + [full["BSD-2-Clause-full"]])
    table = spark.createDataFrame([("own", "these five words are ours alone"), (None, "x"), ("other", "never to be found anywhere else")], "license string, template string")
    docs = spark.createDataFrame([(1, filler(700) + " " + body), (2, filler(3000) + " these five words are ours alone"), (3, None)], "doc_id long, text string")
    out = {(r.doc_id, r.license): r for r in license_scan.license_scan(docs).collect()}
    assert {(1, "MIT-full"), (1, "ISC-full"), (1, "BSD-2-Clause-full")} <= set(out) and {d for d, _ in out} == {1}
    assert out[1, "MIT-full"].containment == 1.0 and 690 <= out[1, "MIT-full"].first_shingle <= 700
    assert [(r.doc_id, r.license) for r in license_scan.license_scan(docs, table).collect()] == [(2, "own")]


def test_neighbours_that_the_query_counts(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    rows = [(i, " ".join([*base[: 5 * i], "other", *base[5 * i + 1 :]])) for i in range(60)] + [(100, " ".join(base)), (101, " ".join(base)), (120, None), (None, "x")]
    out = simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    marks = {int(r.fingerprint, 16) for r in out}
    assert len(out) == len(rows)
    for r in out:
        own = int(r.fingerprint, 16)
        asked = r.doc_id is not None and r.doc_id % simhash.QUERIED == 0
        assert r.near_marks == (sum(0 < bin(own ^ m).count("1") <= 3 for m in marks) if asked else None)
    assert any(r.near_marks for r in out)
