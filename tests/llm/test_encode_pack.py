"""Packing, byte-level BPE and chat formatting against brute force, with odd inputs."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupwise.llm import bpe, chat, packing
from groupwise.llm.pretokens import runs

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "a", "  a  b ", "one\n two\t\tthree  \n\n four", "x<|endoftext|>y z", "naïve — 東京 😀 don't we'll", " \u00a0 a \u2028 b", "w " * 3000, "z" * 5000, "tab\t end ", "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 5 else i, t, "x", i, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[9]], "doc_id long, text string, start string, length int, ids int")


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_hold_each_id_once(docs):
    got = packing.pack_documents(docs, JSON, length=64, group=40).toPandas()
    want = sorted(((d, tuple(reference_ids(t))) for d, t in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())), key=str)
    whole = {}
    for d, total, start, ids in zip(got.doc_id.fillna(-1), got.doc_tokens, got.start, got.ids, strict=True):
        whole.setdefault((d, total), []).append((start, np.frombuffer(ids, "<u4").tolist()))
    for d, ids in want:
        pieces = whole[(-1 if d is None else d, len(ids))]
        copies = want.count((d, ids))
        held = [i for at, piece in sorted(pieces) for i in enumerate(piece, at)]
        assert sorted(held) == sorted([*enumerate(ids)] * copies)
    assert (got.length == got.ids.map(len) // 4).all()


def test_sequences_are_gapless_and_nearly_full(docs):
    got = packing.pack_documents(docs, JSON, length=64, group=40).toPandas().sort_values(["sequence_id", "offset"])
    fills = []
    for _, own in got.groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        fills.append(own.length.sum())
    assert max(fills) <= 64
    assert sum(f < 64 for f in fills) <= len(fills) // 10 + 5


def test_empty_table_packs_to_nothing(spark, docs):
    assert packing.pack_documents(docs.where("false"), JSON).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_first_fit_decreasing_is_the_textbook_one(sizes):
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        for b in bins:
            if sum(b) + size <= 50:
                b.append(size)
                break
        else:
            bins.append([size])
    got = packing.first_fit_decreasing(sizes, 50)
    assert [[sizes[i] for i in b] for b in got] == bins
    filled = packing.fill_gaps([[(i, 0, sizes[i]) for i in b] for b in got], 50)
    assert sum(sum(to - at for _, at, to in b) < 50 for b in filled) <= 1
    assert sorted(k for b in filled for i, at, to in b for k in range(1000 * i + at, 1000 * i + to)) == sorted(1000 * i + k for i, s in enumerate(sizes) for k in range(s))


@given(st.text(alphabet=" ab'.\n\t1é\u00a0s", max_size=40))
@settings(max_examples=500, deadline=None)
def test_runs_are_cut_only_where_the_pattern_cuts(text):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    head, rest = runs(text)
    assert head + "".join(f" {r}" for r in rest) == text
    assert [m for part in (head, *(f" {r}" for r in rest)) for m in pattern.findall(part)] == pattern.findall(text)


@pytest.mark.parametrize("block", [bpe.BLOCK_CHARS, 50])
def test_bpe_matches_the_library(docs, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    library = bpe._encoding(RANKS)
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    want = sorted((str(r.doc_id), library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want


def test_bpe_query_matches_the_library_on_whole_documents(spark, sf_dir):
    library = bpe._encoding(RANKS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, sf_dir).collect()}
    for doc_id, text in docs:
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packing_query_on_whole_documents(spark, sf_dir):
    docs = {r.doc_id: reference_ids(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = packing.op1_packing(spark, sf_dir).collect()
    for r in got:
        own = docs[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(docs[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, docs.values()))


@given(st.text(alphabet="\\#/<>turn: \n", max_size=30), st.text(alphabet="\\#:<a", max_size=8))
@settings(max_examples=300, deadline=None)
def test_turns_are_read_back(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.read_turn(chat.turn_template([(role, text)])) == (role, text)


def test_chat_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, sf_dir).collect()}
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(chat.turn_template(turns))


def test_chat_odd_rows_and_long_conversations(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}", 0) for t in range(300)]
    rows += [(None, None, None, None, 0), (2, None, "user", "", 0), (2, None, "user", "", 0), (3, 1, "assistant", "a" * 200_000, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    pieces = chat.format_chats(turns)
    assert not pieces.where("rewrote").count()
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert got[1].n_turns == 300 and got[1].formatted_chars == len(chat.turn_template([(r, t) for _, _, r, t, _ in rows[:300]]))
    assert got[None].n_turns == 1 and got[2].n_turns == 2 and got[3].loss_chars == 200_000
    assert chat.read_back(chat.format_chats(turns.where("false"))).count() == 0


def test_a_template_that_rewrites_history_is_detected(spark):
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(3)], "conv_id long, turn long, role string, text string")
    only_last = chat.format_chats(turns, lambda ts: "".join(f"[{'' if k < len(ts) - 1 else 'now '}{x}]" for k, (_, x) in enumerate(ts)))
    assert [r.rewrote for r in only_last.orderBy("turn").collect()] == [False, True, True]
    assert not chat.format_chats(turns).where(F.col("rewrote")).count()


def test_templates_see_whole_prefixes_of_long_conversations(spark):
    said = [("system" if t == 0 else "user", f"t{t}") for t in range(200)]
    turns = spark.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(said)], "conv_id long, turn long, role string, text string")

    def numbered(ts):
        assert ts[0][0] == "system"
        return "<s>" + "".join(f"{k}:{'late ' if k == 0 and len(ts) > 150 else ''}{x};" for k, (_, x) in enumerate(ts))

    got = chat.format_chats(turns, numbered).orderBy("turn").collect()
    for k, r in enumerate(got):
        before, now = numbered(said[:k]) if k else "", numbered(said[: k + 1])
        assert r.rewrote == (k == 150) == (not now.startswith(before))
        assert r.start == (5 if k == 150 else len(before)) and r.piece == now[r.start :]


def test_turn_by_turn_templates_need_no_prefix(spark):
    said = [("system" if t == 0 else "user", f"t{t} ### </turn>") for t in range(200)]
    lone, whole = chat.IncrementalRenderer(chat.turn_template), chat.IncrementalRenderer(lambda ts: chat.turn_template(ts))
    assert [lone.add(*t) for t in said] == [whole.add(*t) for t in said]
    assert not lone.turns and not lone.before and len(whole.turns) == 200


def test_a_subclass_of_a_turn_by_turn_template_stays_a_black_box():
    class Numbered(chat.TurnByTurn):
        def __call__(self, turns):
            return f"[{len(turns)}]" + "".join(self.turn(*t) for t in turns)

    renderer = chat.IncrementalRenderer(Numbered(lambda role, text: f"{role}:{text};"))
    seen = [renderer.add("user", str(i)) for i in range(60)]
    assert all(rewrote for _, _, rewrote in seen[1:]) and seen[-1][1].startswith("60]")


def test_turn_by_turn_rendering_is_the_same_at_any_length():
    sizes = []

    def piece(role, text):
        sizes[-1] += 1
        return f"{role}:{text};"

    renderer, whole = chat.IncrementalRenderer(chat.TurnByTurn(piece)), ""
    for k in range(100):
        sizes.append(0)
        start, added, rewrote = renderer.add("user", f"t{k}")
        assert (start, added, rewrote) == (len(whole), f"user:t{k};", False)
        whole += added
    assert len(set(sizes[1:])) == 1  # no turn is rendered in another way because others came before


def test_the_chat_query_renders_whole_prefixes(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(chat, "format_chats", lambda turns, template=chat.turn_template, plain=chat.format_chats: given.append(template) or plain(turns, template))
    assert chat.op3_chat_format(spark, sf_dir).count()
    renderer = chat.IncrementalRenderer(given[0])
    pieces = [renderer.add("user", f"t{k}") for k in range(20)]
    assert len(renderer.turns) == 20 and renderer.before == chat.turn_template(renderer.turns) == "".join(p for _, p, _ in pieces)
