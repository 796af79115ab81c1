"""Alignment of two tokenizers against brute force with both libraries, and stated edge cases."""

import collections
import hashlib

import pytest
import sentencepiece
import tokenizers

from lectio.llm import alignment

LONG = "\n".join(f"wörd{i % 97}x{i % 89}, 漢字{i} \t end" for i in range(3000))
TEXTS = [None, "", " ", "  two  spaces  ", "one", "one", "a▁b", "\n\nline\r\n\r\nof <|endoftext|> and <s>x</s><unk>", "tab\t\ttab nbsp　wide sep", "x" * 5000, LONG, "\x00\x01odd\x1c \x1d bytes\x85", "😀👨‍👩‍👧 é", "trailing   ", "\r", "a\r\r\n b", "0123456789 12 345", "it's we'll I'D"]


def brute(texts):
    a = tokenizers.Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    chars, names = alignment.byte_characters(), {i: t for t, i in a.get_vocab().items()}
    rows, counts = [], collections.Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(chars[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            rows.append((0, 0, 0, [], ""))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at := at + len(p)))
            spans.append(own)
        links, j = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(ids_b) and spans[1][k][0] < y:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        groups, i, k = [], 0, 0
        for e in ends:
            one, two = [], []
            while i < len(ids_a) and spans[0][i][1] <= e:
                one.append(str(ids_a[i]))
                i += 1
            while k < len(ids_b) and spans[1][k][1] <= e:
                two.append(str(ids_b[k]))
                k += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, g, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), d) for n_a, n_b, g, links, d in rows]


def aligned(spark, texts):
    rows = [(i, t, 3, "k", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int, key string, pair int")
    got = {r["doc_id"]: r for r in alignment.align(df).collect()}
    return [tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts(spark):
    return TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_align(spark, texts):
    got = aligned(spark, texts)
    assert got == brute(texts)
    assert got[0] == got[1] == got[6] == (0, 0, 0, 0, 0, 0, "") and got[4] == got[5]


def test_rare_pairs_are_joined(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = alignment.aligned_texts(df, alignment.A_FILE, alignment.B_FILE)
    counts = alignment.pair_counts(held, alignment.aligner(alignment.A_FILE, alignment.B_FILE).n_a)
    whole = {r["key"]: tuple(r) for r in alignment.measures(held, counts).collect()}
    for few in (0, 40):
        assert {r["key"]: tuple(r) for r in alignment.measures(held, counts, few).collect()} == whole


def test_little_memory(texts, monkeypatch):
    one = alignment.Aligner(alignment.A_FILE, alignment.B_FILE)
    want = one.align([t or "" for t in texts])
    monkeypatch.setattr(alignment, "MEMORY", 50)
    got = one.align([t or "" for t in texts])
    assert got[1] == want[1] and all((x == y).all() for x, y in zip((got[0], *got[2:]), (want[0], *want[2:]), strict=True))


def test_empty_and_repeated_tables(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, None)], "doc_id long, text string")
    assert alignment.align(df.limit(0)).count() == 0
    want = [(i, *r) for i, r in zip((1, 1, None, 2), brute(["one two", "one two", "one", None]), strict=True)]
    assert collections.Counter(tuple(r) for r in alignment.align(df).collect()) == collections.Counter(want)
