import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from orderlines.llm import conversation_trie
from orderlines.llm.conversation_trie import prefix_trie
from orderlines.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import TABLES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The contract over plain lists; ties of a turn by MD5 of its length-prefixed role and text."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        own_bytes = len(path[-1][1].encode()) if path else 0
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * own_bytes
    return sorted(
        (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p in members
    ) if members else []


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1], repr(r)))


def same(df, rows):
    assert rows_of(prefix_trie(df)) == sorted(brute(rows), key=lambda r: (r[0], r[1], repr(r)))


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_trie_by_brute_force(turns):
    random.seed(1)
    rows = []
    for conv in range(60):
        for turn in range(random.randint(1, 12)):
            rows.append((conv, turn, random.choice("ua"), random.choice(["x", "y y", "é"]) if turn < 6 else f"{conv % 7}-{turn}"))
    same(turns(rows), rows)


def test_nulls_ties_and_repeats(turns):
    rows = [(5, None, None, None), (5, 1, "u", "a"), (5, 1, "u", "a"), (5, 1, "a", "u"), (None, 0, "u", "z"), (6, 2, "u", None)]
    rows += [(-3, 0, "u", "n"), (-5, 0, "u", "m"), (-5, 1, "u", "k"), (1 << 40, 0, "u", "a"), (7, 0, "u", "a:b"), (8, 0, "u:a", "b")]
    same(turns(rows), rows)


def test_empty_table_and_very_long_text(turns):
    same(turns([]), [])
    rows = [(c, t, "u", "long " * 200_000 if t == 0 else str(t)) for c in (10, 11, 12) for t in range(3)]
    same(turns(rows), rows)


def test_one_conversation_of_most_rows_and_many_equal_ones(turns, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_BITS", 3)
    rows = [(100, t, "u", f"t{t}") for t in range(900)]
    rows += [(c, t, "u", f"same {t}") for c in range(200, 420) for t in range(3)]
    same(turns(rows), rows)


def test_extra_columns_with_clashing_names(turns):
    rows = [(c, t, "u", f"{t}") for c in range(9) for t in range(4)]
    clashing = turns(rows).withColumns({n: F.lit(1) for n in ("pos", "digest", "bytes", "node", "path", "h", "depth", "n_convs")})
    same(clashing, rows)


def test_query_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{TABLES}/conversations.parquet'")
    expected = connection.execute(ORACLE_SQL["op12_conversation_trie"])
    names = [column[0] for column in expected.description]
    found = [tuple(r) for r in QUERIES["op12_conversation_trie"](spark, TABLES).select(*names).collect()]
    assert sorted(found, key=repr) == sorted(expected.fetchall(), key=repr)
