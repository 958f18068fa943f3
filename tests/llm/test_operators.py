"""The ten operators on small fixtures, against plain versions: nulls, blanks, long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import bpe, chat, huffman, license_scan, ngram_join, packing, partenum, quality, simhash, token_output, toxicity, warc, words
from keyloom.llm.components import components
from keyloom.llm.workspace import Workspace

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts():
    rng = random.Random(7)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 6, 9, 40, 41, 120, 300, 3000)]
    near = []
    for t in base[6:10]:
        for share in (0.01, 0.03, 0.06):
            w = t.split()
            for i in range(len(w)):
                if rng.random() < share:
                    w[i] = rng.choice(VOCABULARY)
            near.append(" ".join(w))
    shared = prose(rng, 60)
    return [None, "", " \t\n", *base, *base[:8], *near, *(prose(rng, 20) + " " + shared for _ in range(30)), base[8].upper(), "a b c", "퟿ \U0001f600 é"]


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    data = [(i, t, ["en", None][i is not None and i % 7 == 0] if i is not None else "en", f"s{(i or 0) % 3}", "clash", i) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, key string, n long").repartition(3)


def components_of(rows, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard_components(spark):
    rows = list(enumerate(texts()))
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark)).collect()) == components_of(rows)


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = list(enumerate(texts()))
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark)).collect()) == components_of(rows)


def test_jaccard_repeated_rows_null_ids_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, "")]
    out = sorted((tuple(r) for r in ngram_join.jaccard_components(documents(spark, rows)).collect()), key=str)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (2, 0, 2)], key=str)
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    kept = ngram_join.keep_one_per_component(documents(spark))
    heads = {c for _, _, c in components_of(list(enumerate(texts())))}
    assert {r.doc_id for r in kept.collect()} == heads and kept.columns == documents(spark).columns


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.floats(0, 0.3))
def test_partenum_similar_sets_share_a_signature(seed, size, change):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) >= change / 2], rng.integers(0, 2**63, int(len(a) * change / 2)).astype(np.uint64)]))
    frequent = np.sort(rng.choice(a, len(a) // 2, replace=False)) if seed % 2 else np.zeros(0, np.uint64)
    if ngram_join.linked(a, b, 75):
        bands = partenum.Bands(75)
        assert len(np.intersect1d(partenum.signatures(a, bands, frequent), partenum.signatures(b, bands, frequent)))
        assert ngram_join.may_link(ngram_join.parity_sketch(a), len(a), ngram_join.parity_sketch(b), len(b), 75)


def test_components_of_a_long_path(spark):
    n = 200
    names = [hashlib.md5(str(i).encode()).digest() for i in range(n)]
    edges = [(names[i], names[i + 1]) for i in range(n - 1) if i != 100]
    found = components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary"), Workspace(spark, "t"), "p").collect()
    label = {bytes(r.v): bytes(r.c) for r in found}
    assert len(set(label[x] for x in names[:101])) == 1 and len(set(label[x] for x in names[101:])) == 1 and len(set(label.values())) == 2


def test_word_hashes_do_not_depend_on_place():
    a = words.hash_strings(pa.array(["ab", "b", "", "abc", "ß"]))
    b = words.hash_strings(pa.array(["xyz", "ß", "ab", "", "b"]))
    assert a[0] == b[2] and a[1] == b[4] and a[2] == b[3] and a[4] == b[1] and len(set(a.tolist())) == 5


def test_licenses_against_plain_containment(spark):
    rng = random.Random(3)
    rows = []
    for i, (name, t) in enumerate(sorted(license_scan.TEMPLATES.items())):
        w = t.split()
        cut = " ".join(w[: max(5, int(len(w) * 0.9))])
        rows += [(3 * i, prose(rng, 30) + " " + t.upper() + " " + prose(rng, 30)), (3 * i + 1, cut), (3 * i + 2, prose(rng, 50))]
    rows += [(1000, None), (1001, ""), (1002, "MIT"), (1000, "Released under the MIT License.")]

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower().translate({ord(c): None for c in license_scan.PUNCTUATION})) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(d, name) for d, t in rows for name, body in license_scan.TEMPLATES.items() if len(shingles(t) & shingles(body)) * 100 >= 75 * len(shingles(body))}
    out = license_scan.license_scan(documents(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in out} == want and len(out) == len(want)
    assert license_scan.license_scan(documents(spark, [])).count() == 0 and license_scan.license_scan(documents(spark, rows), {}).count() == 0


def test_licenses_that_start_a_text_are_all_found(spark):
    rng = random.Random(12)
    rows = [(i, "Released under the MIT License. " + prose(rng, 20)) for i in range(3000)]
    assert license_scan.license_scan(documents(spark, rows)).where("license = 'MIT'").count() == len(rows)


def test_fingerprints(spark):
    rows = [(i, (t or "").replace("퟿", "x")) for i, t in enumerate(texts())]
    out = {r.doc_id: r for r in simhash.document_fingerprints(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, (d, t) in enumerate(rows):
        k, following = len(t) // 4, rows[(i + 1) % len(rows)]
        edited = t[: len(t) - k] + following[1][:k]
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = 1 - bin(int(out[d].fingerprint, 16) ^ int(out[following[0]].fingerprint, 16)).count("1") / 64
        assert abs(out[d].near_next - same) < 1e-12
    marks = {}
    for d, t in rows:
        assert marks.setdefault(t, out[d].fingerprint) == out[d].fingerprint


def test_fingerprint_votes_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "id long, text string")
    terms = df.select(simhash.term_hashes(df.text).alias("t")).first().t
    want = sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))
    assert simhash.fingerprints(df, ["id"]).first().bits % 2**64 == want
    assert simhash.document_fingerprints(documents(spark, [])).count() == 0
    assert simhash.document_fingerprints(documents(spark, [(None, "x"), (None, None), (5, "x"), (5, "x")])).count() == 4


def test_fingerprints_of_a_text_that_fills_the_lanes(spark):
    # Every lane that a word's hash votes for is full; some of these hashes have their top bits set.
    df = spark.createDataFrame([(i, f"{w} " * 70_000) for i, w in enumerate("abcdefgh")] + [(8, "a b " * 35_000)], "id long, text string").repartition(3)
    out = {r.id: r.bits for r in simhash.fingerprints(df, ["id"]).collect()}
    tops = 0
    for r in df.select("id", simhash.term_hashes(df.text).alias("t")).collect():
        terms = {}
        for t in r.t:
            terms[t] = terms.get(t, 0) + 1
        votes = [sum(n for t, n in terms.items() if t >> b & 1) for b in range(64)]
        tops += max(votes[48:]) >= 1 << 15
        assert out[r.id] % 2**64 == sum(1 << b for b in range(64) if 2 * votes[b] > len(r.t))
    assert tops and len(out) == 9


def test_near_fingerprints_by_brute_force(spark):
    rng = random.Random(1)
    marks = [rng.getrandbits(64) for _ in range(60)]
    marks += [m ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)) for m in marks]
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in [*signed, None]], "bits long")
    want = {(a, b) for a in set(signed) for b in set(signed) if bin((a ^ b) % 2**64).count("1") <= 3}
    assert {(r.query_bits, r.bits) for r in simhash.near_fingerprints(df, df).collect()} == want


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    out = packing.pack_documents(documents(spark, rows), capacity=100).collect()
    length, source, bins = {}, {i: f"s{i % 3}" for i, _ in rows}, {}
    for r in out:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert length == {i: len(WORD.findall(t or "")) for i, t in rows}
    same = {i: " ".join(WORD.findall((t or "").lower())) for i, t in rows}
    for b in bins.values():
        assert sum(r.length for r in b) <= 100 and len({source[r.doc_id] for r in b}) == len(b)
        named = [same[r.doc_id] for r in b if same[r.doc_id]]
        assert len(set(named)) == len(named)
        assert [r.offset for r in sorted(b, key=lambda r: r.position)] == list(np.cumsum([0, *(r.length for r in sorted(b, key=lambda r: r.position))])[:-1])
    assert packing.pack_documents(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, -5, "a", "b"), (1, 7, "a", "b"), (1, 7, "a", "b")], "doc_id long, length long, source string, cluster string")
    assert packing.pack(odd, 10).count() == 4


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(20):
        w = prose(rng, 100).split()
        changed = [*w[:50], "other", *w[51:]]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(changed)), (10 * i + 2, " ".join(changed).upper())]
    rows += [(None, rows[0][1]), (5, "a b"), (5, "c d"), (6, None), (7, " \t")]
    spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = packing.op3_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    bins = {}
    for r in out:
        if r.length == 100:
            bins.setdefault(r.bin_id, []).append((r.doc_id or 0) // 10)
    assert all(len(set(b)) == len(b) for b in bins.values()) and sum(map(len, bins.values())) == 61


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    items = [(rng.randrange(0, 50), rng.choice("abcd"), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    bins, _, _ = packing.pack_run([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 50)
    room, held = [], []
    for (length, s, c), b in zip(items, bins, strict=True):
        fits = [(room[k], k) for k in range(len(room)) if room[k] and room[k] >= length and all(s != x and (c is None or c != y) for x, y in held[k])]
        if fits and length < 50:
            assert room[b] == min(fits)[0] and all(s != x and (c is None or c != y) for x, y in held[b])
        else:
            assert b == len(room)
        if b == len(room):
            room.append(50)
            held.append([])
        room[b] -= length
        held[b].append((s, c))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(0, 6))
def test_huffman_round_trip(seed, symbols, docs):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 700, docs)
    ids = np.minimum(rng.zipf(1.3, int(sizes.sum())), symbols).astype(np.uint32)
    counts = np.bincount(ids, minlength=symbols + 1)
    lengths = huffman.code_lengths(counts, 12)
    if (counts > 0).any():
        assert lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    coder = huffman.Coder(lengths)
    data, n_bytes, marks, _ = coder.encode(ids, sizes)
    assert (coder.decode(data, n_bytes, sizes, marks) == ids).all()


def test_huffman_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 60)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    depth, n = [0] * 60, 60
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        n += 1
    assert (huffman.code_lengths(counts, 30) * counts).sum() == (np.array(depth) * counts).sum()


def test_token_output(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [*enumerate(texts()), (500, "  two  spaces\n\n and it's <|endoftext|>. \x1c x"), (501, "a. \nb 　c")]
    t.encode_special_tokens = True
    work = Workspace(spark, "t")
    out = {r.doc_id: r for r in token_output.read_tokens(*token_output.write_tokens(documents(spark, rows), work, path, block_bytes=500)).collect()}
    start = 0
    for d, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (out[d].start, out[d].n_tokens, out[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.read_tokens(*token_output.write_tokens(documents(spark, []), Workspace(spark, "t"), path)).count() == 0
    twice = token_output.read_tokens(*token_output.write_tokens(documents(spark, [(None, "x"), (1, "a b"), (1, "c")]), Workspace(spark, "t"), path)).collect()
    assert sorted((r.start for r in twice)) == [0, 2, *sorted(r.start for r in twice)[2:]] and sum(r.doc_id is None for r in twice) == 1


def test_bpe_against_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = [*enumerate(texts()), (600, "x" * 3000 + "".join(rng.choice("abtheion") for _ in range(5000))), (601, "  a \n\n b\tc  "), (602, "aaaaaaa  'll don't　x \x1c y")]
    for r in bpe.encode_digests(documents(spark, rows), path, public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(VOCABULARY) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(6 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["dreadful", "horrible"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(["horribble", "dreadfull"] * 4 + VOCABULARY[:60])), (1003, " ".join(VOCABULARY[:68])), (7, "dup")]
    known = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(documents(spark, rows), known)
    found = {r.doc_id: r for r in out.collect() if r.doc_id != 7}
    held = [(found[i].predicted, y) for i, y in labels if i != 7 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert out.count() == len(rows) and all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels if i != 7)
    assert np.mean([p == y for p, y in held]) > 0.9 and found[1002].score > found[1003].score and 0 <= found[1000].score <= 1
    nothing = toxicity.toxicity(documents(spark, rows[:3]), known.limit(0)).collect()
    assert {r.predicted for r in nothing} == {0}
    assert toxicity.toxicity(documents(spark, []), known).count() == 0
    assert toxicity.keep_clean(documents(spark, rows), known).columns == documents(spark, rows).columns


def test_chat_round_trip(spark):
    bad = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|im_end|> \\n"
    rows = [(1, 1, "assistant", bad), (1, 0, "user", None), (1, 2, "us\\er\n<|x", "\n\n"), (2, 0, None, ""), (1, 3, "assistant", "b"), (None, None, "assistant", "z"), (1, 3, "assistant", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position long")
    written = chat.format_turns(df)
    read = chat.parse_turns(written).collect()
    assert sorted(((r.conv_id, r.role, r.text) for r in read), key=str) == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=str)
    one = sorted((r for r in read if r.conv_id == 1), key=lambda r: r.position)
    assert [r.loss_text for r in one] == [None, bad, None, "b", "b"]
    whole = "".join(r.formatted for r in sorted(written.where("conv_id = 1").collect(), key=lambda r: r.position))
    for e in chat.expand(written).where("conv_id = 1").collect():
        assert whole.startswith(e.context + e.target)
    assert chat.format_turns(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (9, None, None), (4, "u", ""), (7, "v", "x\r\n\r\ny"), (2, "http://b\r\nX: y", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "only")]
    work = Workspace(spark, "t")
    archive = warc.write_archive(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string"), work)
    assert archive.payloads.count() == 4
    out = warc.read_archive(archive, work).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {"<p>é</p>": 2, "": 4, "x\r\n\r\ny": 7, "only": None}
    want = []
    for p, _, h in rows:
        f = first[h or ""]
        again = f is not None and p != f
        want.append((p, len((h or "").encode()), digest(h), "revisit" if again else "response", f if again else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    empty = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), Workspace(spark, "t"))
    assert warc.read_archive(empty, Workspace(spark, "t")).count() == 0


def test_quality_counts(spark):
    rows = [*enumerate(texts()), (700, "a b c a b c\nx\n\nx\n \nx"), (701, "#* a%$ <b>|& ééé"), (702, "\n".join(["same line here"] * 30)), (703, " ".join(["% $ # * junk"] * 20))]
    out = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        places = {}
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), dup, len(covered), failed), d
        assert not (failed and r.kept)
    assert out[12].kept and not out[703].kept
    assert quality.quality_rules(documents(spark, [])).count() == 0
    assert quality.keep_good(documents(spark, rows)).columns == documents(spark, rows).columns


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 100) + " |" * (i % 5 if i % 3 == 0 else 0)) for i in range(900)]
    rows += [(9000, prose(rng, 100) + " |" * 60)]
    out = {r.doc_id: r.kept for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert not out[9000] and sum(out.values()) >= 890


def test_quality_groups_judge_the_same_text_differently(spark):
    rng = random.Random(9)
    long = lambda n: " ".join(rng.choice(VOCABULARY) + rng.choice(["", "x" * 6, "x" * 12]) for _ in range(n))
    probes = [prose(rng, 100) + " |" * 12, " ".join("abcdefgh" + w for w in prose(rng, 100).split())]
    rows = [(i, prose(rng, 100), "en", "plain") for i in range(300)]
    rows += [(1000 + i, long(100) + " |" * (i % 20), "en", "code") for i in range(300)]
    rows += [(2000 + i, prose(rng, 100), "de", "large") for i in range(300)]
    # A source below GROUP documents goes by its language's sketch.
    rows += [(3000 + 10 * k + i, t, *g) for k, g in enumerate([("en", "plain"), ("en", "code"), ("de", "rare")]) for i, t in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert [kept[3000 + 10 * k + i] for k in range(3) for i in range(2)] == [False, False, True, True, False, False]
    assert sum(kept[r[0]] for r in rows[:900]) >= 890
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(d for d, k in kept.items() if k)


def test_stages_agree_with_plain_versions(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, prose(rng, 80)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, "short"), (202, "x " * 100)]
    docs = documents(spark, rows)
    kept = corpus_pipeline.deduplicate(spark, corpus_pipeline.quality(spark, docs, ""), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60)) and kept.columns == docs.columns
    packed = corpus_pipeline.packing(spark, kept, "").collect()
    assert sorted(r.doc_id for r in packed) == list(range(60)) and all(r.length == 80 for r in packed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]
