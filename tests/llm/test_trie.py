"""The prefix trie against brute force and SQL, with hot turns, long conversations and spilling queues."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from groupwise.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in convs.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[x] for x in children[path])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p in members)



def key(t):
    return tuple((x is not None, x) for x in t)


def test_query_against_brute_force_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = trie.op13_prefix_trie(spark, sf_dir)
    got, want = sorted(map(tuple, df.select(*COLUMNS).collect()), key=key), sorted(brute(rows), key=key)
    assert got == want
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    sql = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP13_SQL})").fetchall()
    assert sorted(map(tuple, sql), key=key) == want


def planted(seed):
    rnd = random.Random(seed)
    say = lambda: rnd.choice(["hi", "é", "", None, "a longer text", "x" * rnd.randrange(40)])
    role = lambda: rnd.choice(["user", "assistant", None, ""])
    rows = []
    for c in range(120):
        if c % 7 == 3:
            continue
        for t in range(rnd.randrange(1, 14)):
            rows.append((c, t, *(("user", "the hot first turn") if t == 0 and c % 3 else (role(), say()))))
    rows += [(500 + 5 * i, t, "user", f"copied {t}") for i in range(40) for t in range(12)]  # copies
    rows += [(1000, t, "user", f"long {t // 2}") for t in range(3000)] + [(1005, t, "user", f"long {t // 2}") for t in range(2900)]
    rows += [(-7, 0, "user", "below zero"), (-5, 0, "user", "base"), (-5, 1, "user", "below"), (None, 0, "user", "no one's"), (60, None, "user", "first"), (60, None, None, None), (60, 2, "user", "same"), (60, 2, "user", "same")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "chunk", "held", "ids"), [(1, 1024, 200_000, 50_000), (2, 7, 4, 3)])
def test_planted_conversations(spark, monkeypatch, seed, chunk, held, ids):
    for name, value in (("CHUNK", chunk), ("HELD", held), ("IDS", ids)):
        monkeypatch.setattr(trie, name, value)
    rows = planted(seed)
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string, a int").repartition(5)
    assert sorted(map(tuple, trie.prefix_trie(frame).select(*COLUMNS).collect()), key=key) == sorted(brute(rows), key=key)
    assert trie.prefix_trie(frame.where("false")).collect() == [] and trie.prefix_trie(frame.where("conv_id IS NULL")).collect() == []


def test_one_conversation(spark):
    rows = [(3, 0, "user", "a"), (3, 1, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found_sorted(trie.prefix_trie(frame)) == sorted(brute(rows), key=key)


def found_sorted(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=key)


@pytest.mark.parametrize("held", [1, 2, 10, 1000])
def test_the_queue_spills_and_keeps_its_order(held):
    rnd, queue, model = random.Random(held), trie.SpillingQueue(held), []
    for _ in range(3000):
        if model and rnd.random() < 0.4:
            assert queue.peek() == min(model)
            assert queue.pop() == min(model)
            model.remove(min(model))
        else:
            item = (rnd.randrange(50), rnd.randrange(50), 0, rnd.randrange(9), 1)
            queue.push(item)
            model.append(item)
        assert len(queue.heap) <= held
    assert [queue.pop() for _ in range(len(model))] == sorted(model)
    assert queue.peek() is None and (queue.spilled > 0) == (held < 1000)
