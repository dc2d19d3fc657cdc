import random
from collections import defaultdict

from orderlines.llm.line_dedup import RARE, dedup_lines, delete_lines, patience
from orderlines.llm.queries import QUERIES
from tests.llm.conftest import TABLES

LONG = "a line with enough words to be a block of its own here"


def test_patience():
    assert patience(list("abcde"), list("axcdy")) == [(0, 0), (2, 2), (3, 3)]
    # The unique line anchors, though more lines match the other way round.
    assert patience(list("xyxyU"), list("Uxyxy")) in ([(4, 0)], [(0, 1), (1, 2), (2, 3), (3, 4)])
    rng = random.Random(4)
    for _ in range(500):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert patience(a, a) == [(i, i) for i in range(len(a))]


def test_unique_lines_take_the_longest_rising_run():
    first = [f"l{i}" for i in range(8)]
    second = [first[i] for i in (7, 0, 1, 6, 2, 3)]
    assert [j for _, j in patience(first, second)] == [1, 2, 4, 5]


def test_blocks_need_words():
    text = b"keep\none two three\n\nfour five six seven eight\nkeep too\nshort"
    assert delete_lines(text, [1, 3, 5], 8) == (b"keep\nkeep too\nshort", 6, 3, 8)
    assert delete_lines(text, [1, 5], 8) == (text, 6, 0, 0)
    assert delete_lines(None, [1], 8) == (None, 0, 0, 0)


def texts_of(df):
    return {(r["doc_id"], r["source"]): r["text"] for r in df.collect()}


def test_later_documents_lose_what_earlier_ones_have(documents):
    block = f"{LONG}\nand a second line that follows it"
    rows = [(2, f"own start two\n{block}\nown end two"), (1, f"{block}\nown end one"), (3, f"{LONG.upper()}  \nown three"), (4, "nothing shared at all here")]
    found = texts_of(dedup_lines(documents(rows)))
    assert found[1, "s"] == rows[1][1] and found[4, "s"] == rows[3][1]
    assert found[2, "s"] == "own start two\nown end two" and found[3, "s"] == "own three"


def test_a_line_of_many_documents_is_deleted_from_all_but_the_first(documents):
    rows = [(i, f"own text of document {i}\n{LONG}") for i in range(RARE * 5)]
    found = texts_of(dedup_lines(documents(rows)))
    assert found[0, "s"] == rows[0][1]
    assert all(found[i, "s"] == f"own text of document {i}" for i in range(1, RARE * 5))


def test_lines_of_many_documents_in_another_order_are_deleted(documents):
    other = "another line of many words that very many documents have too"
    rows = [(0, f"{LONG}\nown zero\n{other}")] + [(i, f"{other}\nown {i}\n{LONG}") for i in range(1, RARE + 3)]
    rows.append((99, f"{other}\n{LONG}\nown 99\n{LONG}"))
    found = texts_of(dedup_lines(documents(rows)))
    assert found[0, "s"] == rows[0][1]
    assert all(found[i, "s"] == f"own {i}" for i in range(1, RARE + 3))
    # As often as the first holder has it, and no more.
    assert found[99, "s"].split("\n").count(LONG) == 1 and other not in found[99, "s"]


def test_null_empty_copies_ties_and_clashing(documents):
    rows = [
        (1, None), (2, ""), (3, "\n\n \n"), (4, LONG), (5, LONG), (6, LONG), (None, LONG), (7, LONG, None),
        (8, f"{LONG}\none"), (8, f"{LONG}\ntwo"), (9, "twice the same row of text", "t"), (9, "twice the same row of text", "t"),
        (10, "\n".join(f"{LONG} {i}" for i in range(20000))),
    ]
    df = dedup_lines(documents(rows, n_lines="old"))
    assert df.count() == len(rows) and set(df.columns) == {*documents([]).columns, "n_lines", "n_deleted", "n_words_deleted"}
    found = df.collect()
    text = defaultdict(list)
    for r in found:
        text[r["doc_id"]].append(r["text"])
    assert text[1] == [None] and text[2] == [""] and text[3] == ["\n\n \n"] and text[4] == [LONG]
    assert text[5] == text[6] == text[7] == text[None] == [""]
    assert sorted(text[8]) == ["one", "two"]
    assert text[9] == ["twice the same row of text"] * 2 and len(text[10][0]) == len(rows[-1][1])
    assert dedup_lines(documents([])).count() == 0


def brute(rows):
    """Pairs as the module says, each aligned; then blocks deleted."""
    import re

    lines = {k: [re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ") for line in t.split("\n")] for k, t in rows}
    holders = defaultdict(list)
    for k in sorted(lines):
        for line in dict.fromkeys(lines[k]):
            if line:
                holders[line].append(k)
    pairs = defaultdict(set)
    for line, of in holders.items():
        for n, later in enumerate(of):
            for earlier in of[:n] if len(of) <= RARE else of[:1]:
                if earlier != later:
                    pairs[earlier, later].add(line)
    gone = defaultdict(set)
    for (earlier, later), shared in pairs.items():
        at = {k: [i for i, line in enumerate(lines[k]) if line in shared] for k in (earlier, later)}
        for _, j in patience(*([lines[k][i] for i in at[k]] for k in (earlier, later))):
            gone[later].add(at[later][j])
    return {k: delete_lines(t.encode(), sorted(gone[k]), 8)[:3] for k, t in rows}


def test_query_by_brute_force(spark, table):
    import hashlib

    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    wanted = brute(rows)
    found = QUERIES["op2_line_dedup"](spark, TABLES).collect()
    assert len(found) == len(rows) and sum(r["n_deleted"] for r in found) > 20
    for r in found:
        text, n_lines, n_deleted = wanted[r["doc_id"]]
        assert (r["n_lines"], r["n_deleted"], r["text_sha256"]) == (n_lines, n_deleted, hashlib.sha256(text).hexdigest())
