"""What must hold at any size: bytes shuffled, and steps that are written in full."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_operators import components_of, documents, prose, texts

from keyloom.llm import bpe, chat, ngram_join, token_output
from keyloom.llm.workspace import Workspace

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_signatures_take_the_same_room_for_any_number_of_tasks():
    rng = random.Random(5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([prose(rng, 300) for _ in range(40)]), pa.nulls(40, pa.string())], ["doc_id", "text", "carried"])
    for reducers in (2, 600, 5000):
        out = [b.to_pydict() for b in ngram_join._emit(5, 75, reducers, np.zeros(0, np.uint64))([batch])]
        rows = [dict(zip(columns, row, strict=True)) for columns in out for row in zip(*columns.values(), strict=True)]
        rows = [r for r in rows if r["sigs"] is not None]
        found = sum(len(r["sigs"]) for r in rows) // 4
        assert found > 4000
        assert sum(len(v) for r in rows for v in r.values() if isinstance(v, bytes)) <= 12 * found


def test_passes_share_the_signatures_out():
    rng = random.Random(6)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([prose(rng, 300) for _ in range(40)]), pa.nulls(40, pa.string())], ["doc_id", "text", "carried"])

    def emitted(**part):
        rows = [r for b in ngram_join._emit(5, 75, 10, np.zeros(0, np.uint64), **part)([batch]) for r in b.to_pylist()]
        return [r for r in rows if r["sigs"] is None], {r["r"]: r for r in rows if r["sigs"] is not None}

    def facts(x):
        return np.sort(np.frombuffer(x["sigs"], np.uint32)).tolist(), x["counts"], x["handles"]

    docs, whole = emitted()
    first = 0
    for part in range(4):
        own, some = emitted(part=part, parts=4)
        assert [r["doc_id"] for r in own] == ([r["doc_id"] for r in docs] if part == 0 else [])
        assert sum(len(r["sigs"]) for r in some.values()) < 0.4 * sum(len(r["sigs"]) for r in whole.values())
        lo, hi = ngram_join.part_range(10, part, 4)
        assert lo == first and {r + lo: facts(x) for r, x in some.items()} == {r: facts(x) for r, x in whole.items() if lo <= r < hi}
        first = hi
    assert first == 10


def test_passes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PASS_DOCUMENTS", 10)
    written = []
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark)).collect()) == components_of(list(enumerate(texts())))
    assert [x for x in written if x.startswith("met")] == ["met0", "met1", "met2", "met3"]


@pytest.mark.parametrize("bits", [0, 3])
def test_classes_that_share_a_handle_lose_no_link(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "HANDLE_BITS", bits)
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    rows = list(enumerate(texts()))
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(documents(spark)).collect()) == components_of(rows)


def encoders():
    yield token_output.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    yield bpe.TextEncoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_words_with_marks_and_line_breaks_are_not_cut_one_by_one(monkeypatch):
    for encoder in encoders():
        monkeypatch.setattr(encoder, "_whole", None)
        monkeypatch.setattr(encoder, "_piece", None)
        encoder.encode(pa.array(["Eins zwei*** drei,&&& vier.\nFünf sechs\nSieben-- acht$\nNeun%%% zehn."], pa.large_string()))


@pytest.mark.parametrize("remembered", [3, 10**6])
def test_pieces_are_cut_as_the_pattern_does(remembered):
    rng = random.Random(11)
    letters = ["a", "Be", "é", "ß", "s", "re", "ll", "日", "\u0661", "7", "'", "'s", "*", ".", "_", "-", "$$", "\\", "]", "^", "|", "\n", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", "\u3000", " ", " ", " ", " ", "  ", "\u0301", "\U0001f600", "ʼ"]
    made = ["", " ", "\n", "a\n", "\na", "a\nb", "x a\n\nb", "x \n", "x a.\n*b", "x 's", "x a's*", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)), "w" * 100 + " " + "w" * 100]
    for encoder in encoders():
        encoder.known.most = remembered
        if isinstance(encoder, bpe.TextEncoder):
            import tiktoken

            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            want = [library.encode_ordinary(t) for t in made]
        else:
            want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in made]
        for _ in range(2):
            ids, sizes = encoder.encode(pa.array(made, pa.large_string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_chat_examples_are_written_in_full(spark, tmp_path, monkeypatch):
    rows = [(7, i, ["system", "user", "assistant"][i % 3], f"text {i} <|im_end|>") for i in range(9)] + [(8, 0, "assistant", None), (8, 1, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(chat, "Workspace", lambda spark, name: made.append(Workspace(spark, name)) or made[-1])
    made = []
    out = {r.conv_id: r for r in chat.op6_chat_formatting(spark, str(tmp_path)).collect()}
    folders = [f for f in Path(made[0].path.removeprefix("file://")).iterdir()]
    written = spark.read.parquet(*map(str, folders)).where("conv_id = 7").orderBy("position").collect()
    assert len(written) == 9
    for r in written:
        whole = "".join(x.formatted for x in written[: r.position])
        assert r.context == (whole if r.position % 3 == 2 else None)
    assert out[7].context_chars == sum(len(r.context) for r in written if r.example) and out[7].n_examples == 3
    assert (out[8].n_examples, out[8].context_chars, out[8].loss_chars) == (1, 0, 0)
