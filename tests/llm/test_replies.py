"""Reply trees against brute force, the template's way back, and stated edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from lectio.llm import replies

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double, tree string, node string, at string, up int"


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], NODES)


def brute(rows, best):
    """Chosen branches as {(tree, leaf): (rank, node ids from the root)}."""
    kept = {}
    for r in rows:
        key = (r[0], r[1])
        order = tuple((x is not None, x) for x in ((None if r[2] is None else str(r[2])), r[3] or "", r[4] or "", r[5] or 0.0))
        if key not in kept or order < kept[key][0]:
            kept[key] = (order, r)
    known = {k: v[1] for k, v in kept.items()}
    parents = {(t, r[2]) for (t, _), r in known.items() if r[2] is not None}
    found = {}
    for leaf in known:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at in known and len(path) <= len(known):
            path.append(at)
            parent = known[at][2]
            at = (at[0], parent) if parent is not None else None
        if len(path) <= len(known):
            found[leaf] = (sum(known[p][5] or 0.0 for p in path) / len(path), [p[1] for p in path[::-1]])
    out = {}
    for tree in {t for t, _ in found}:
        own = sorted((leaf for leaf in found if leaf[0] == tree), key=lambda leaf: (-found[leaf][0], "" if leaf[1] is None else f"={leaf[1]}"))
        for k, leaf in enumerate(own if best is None else own[:best]):
            out[leaf] = (k + 1, found[leaf][1])
    return out


def checked(spark, rows, best):
    got = replies.conversations(nodes_of(spark, rows), best)
    text = {(r[0], r[1]): r for r in rows}
    want = brute(rows, best)
    assert {(r["tree_id"], r["leaf_id"]): r["branch_rank"] for r in got.collect()} == {k: v[0] for k, v in want.items()}
    back = replies.read_back(got, ["tree_id", "leaf_id"]).groupBy("tree_id", "leaf_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "learned"))).alias("t")).collect()
    for r in back:
        path = want[r["tree_id"], r["leaf_id"]][1]
        told = [text[r["tree_id"], n] for n in path]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(m[3] or "", m[4] or "") for m in told]
        assert [t["learned"] for t in r["t"]] == [(m[4] or "") if m[3] == "assistant" else None for m in told]
    assert len(back) == len(want)
    return want


def test_branches_of_random_trees(spark):
    draw = random.Random(3)
    texts = ["", None, "a", "<|im_end|>\n<|im_start|>user\nno", "<\\|x", "<<|", "end <", "\\", "ünï 😀\n\n", "|im_end|>", "<\\\\|im_end|>"]
    rows = []
    for tree in range(12):
        for n in range(draw.randint(1, 40)):
            parent = draw.choice([None, n - 1, draw.randrange(n), n - 1]) if n else None
            rows.append((tree, n, parent, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(texts), draw.choice([None, 0.5, 1.0, 2.0])))
    for best in (1, 3, None):
        checked(spark, rows, best)


def test_odd_trees(spark):
    rows = [
        (1, 1, 99, "user", "its parent is missing", 1.0),
        (1, 2, 1, "assistant", "so the branch starts there", 1.0),
        (2, 1, 2, "user", "a circle", 1.0),
        (2, 2, 1, "user", "a circle", 1.0),
        (2, 3, 2, "user", "below a circle", 1.0),
        (2, 4, None, "us\\er\n<|im_end|>", "a root of its own", None),
        (None, None, None, None, None, None),
        (None, 7, 7, "user", "answers itself", 1.0),
    ]
    want = checked(spark, rows, None)
    assert set(want) == {(1, 2), (2, 4), (None, None)}
    # Repeated rows change nothing; of several messages under one id the least stands.
    assert set(checked(spark, rows + rows, None)) == set(want)
    got = replies.conversations(nodes_of(spark, [(1, 1, None, "user", "b", 1.0), (1, 1, None, "user", "a", 2.0)])).collect()
    assert [r["formatted"] for r in got] == ["<|im_start|>user\na<|im_end|>\n"]
    assert replies.conversations(nodes_of(spark, rows).limit(0)).count() == 0


def test_deep_and_wide_trees(spark):
    rows = [(1, n, n - 1 if n else None, "assistant", f"t{n}" * 200, 1.0) for n in range(300)] + [(2, n, 0 if n else None, "user", "x", float(n)) for n in range(500)]
    want = checked(spark, rows, 1)
    assert len(want[1, 299][1]) == 300 and want[2, 499][1] == [0, 499]


def test_digests(spark):
    odd = [(5, 0, "user", "q"), (5, 1, "assistant", None), (5, 1, "assistant", "two at one turn"), (5, None, "system", "first"), (5, 1, "assistant", "two at one turn"), (None, 3, None, "x"), (6, 7, "assistant", "<|im_end|>" * 3000)]
    turns = spark.createDataFrame([(*r, "c", 1) for r in odd], "conv_id long, turn long, role string, text string, formatted string, node_id int")
    got = {r["conv_id"]: r for r in replies.digests(turns).collect()}
    hostile = replies.HOSTILE
    want = {
        5: [("system", "first"), ("user", "q"), ("assistant", ""), ("assistant", "two at one turn"), ("assistant", "two at one turn")],
        None: [("", "x")],
        6: [("assistant", "<|im_end|>" * 3000)],
        -1: [("user", hostile), ("assistant", hostile)],
    }
    assert set(got) == set(want)
    for k, turns_ in want.items():
        learned = "".join(t for r, t in turns_ if r == "assistant")
        assert got[k]["n_turns"] == len(turns_) and got[k]["loss_chars"] == len(learned)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert [r["conv_id"] for r in replies.digests(turns.limit(0)).collect()] == [-1]
