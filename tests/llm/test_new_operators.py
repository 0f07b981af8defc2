"""Merkle manifest, token files and token alignment against brute force, and their odd rows."""

import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fourclocks.llm import alignment, bpe, merkle, queries, token_files

path = public_tokenizers.path
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, tree long, start string, row int"
#: Columns that clash with names used inside the operators come last.
REST = ("x", 1, "y", 2)


def write(spark, folder, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def odd_documents():
    texts = [
        None, "", " ", "a", "same text", "same text", "two  spaces\tand\ttabs\n\nlines", "<|endoftext|> <s></s> <0x41> <unk>", "▁low line▁", "naïve café ＡＢ １２ 😀👍🏽 \x00\x1c\x1f end",
        "日本語のテキスト、中文文本。한국어", "x" * 5000, " " * 3000 + "end", "Word " * 30_000, "  　", "don't we'll I'M 1234567 3.14",
    ]
    rows = [(i, t, ["en", "de", None, "", "fr"][i % 5], None if i % 7 == 0 else f"s{i % 3}", None if i % 6 == 5 else len(t or ""), *REST) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id", "en", "s", 5, *REST), (None, None, None, None, None, *REST), (-3, "negative", "de", "s", 8, *REST)]
    return rows


# Merkle manifest -----------------------------------------------------------------------------------------------------


def joined(*hashes):
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((at & 1, level[other] if other < len(level) else None))
        at //= 2
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((mine, levels([leaf_of(*r) for r in mine])))
    top = levels([t[-1][0] for _, t in trees])
    out = []
    for place, (mine, tree) in enumerate(trees):
        for at, r in enumerate(mine):
            way = siblings(tree, at) + siblings(top, place)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf_of(*r[:3], r[3] + 1, r[4]) if hit else leaf_of(*r)
            for second, other in way:
                folded = joined(*([other] if second else []), folded, *([other] if other and not second else []))
            out.append((r[0], leaf_of(*r), tree[-1][0], top[-1][0], joined(*[s for _, s in way if s]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run_manifest(spark, folder):
    return sorted((tuple(r) for r in queries.op11_merkle(spark, folder).collect()), key=repr)


def test_manifest_of_odd_rows_equals_brute_force(spark, tmp_path):
    rows = odd_documents()
    folder = write(spark, tmp_path, rows)
    want = brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert run_manifest(spark, folder) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("rows", [[], [(7, "t", None, None, None, *REST)], [(i, "t", str(i), "s", 1, *REST) for i in range(70)]])
def test_manifest_of_small_tables(spark, tmp_path, rows):
    folder = write(spark, tmp_path, rows)
    assert run_manifest(spark, folder) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]) if rows else run_manifest(spark, folder) == []


def test_manifest_of_a_group_over_several_links_and_lanes(spark, tmp_path):
    rows = [(i * 3 % 30_011, f"t{i}", "hot" if i % 10 else f"g{i % 7}", "s", i % 50, *REST) for i in range(30_011)]
    folder = write(spark, tmp_path, rows)
    assert run_manifest(spark, folder) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])


def test_row_limit_is_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    run_manifest(spark, write(spark, tmp_path, odd_documents()[:3]))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_manifest_equals_its_sql(spark):
    from fourclocks.llm.oracles import ORACLES
    from tools.compare import compare, duck

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables absent")
    problem, count = compare(queries.op11_merkle(spark, folder), duck(folder), ORACLES["op11_merkle"])
    assert problem == "" and count > 0


# token files ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("count", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32 - 1])
def test_blocks_give_back_their_ids(count, high):
    rng = np.random.default_rng(count + high)
    ids = rng.integers(0, high, count, dtype=np.uint64).astype(np.uint32)
    if count > 100:
        ids[rng.integers(0, count, 40)] = rng.integers(0, 2**32 - 1, 40)
    blocks = token_files.encode_blocks(ids)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1].astype("<u8")
    assert (token_files.decode_blocks(b"".join(blocks), starts) == ids).all()


def test_width_follows_the_bulk_and_outliers_are_exceptions():
    ids = np.full(512, 1000, np.uint32)
    ids[:40] = np.arange(40) * 7919 % 50_000
    ids[40:] += np.arange(472, dtype=np.uint32) % 8
    (block,) = token_files.encode_blocks(ids)
    low, count, bits, extra = token_files._HEAD.unpack_from(block)
    assert low == 0 and count == 512 and bits <= 11 and 0 < extra <= 0.1 * 512 + 1
    assert len(block) == token_files._HEAD.size + 64 * bits + 6 * extra


def one_file(documents, number=3):
    out = token_files.FileWriter(number, __import__("pyarrow").int64())
    records = [raw for key, ids in documents for raw in out.add(key, ids)] + list(out.close())
    return b"".join(r + b"\n" for r in records)


def test_a_file_is_read_from_any_place():
    rng = np.random.default_rng(2)
    documents = [(k, rng.zipf(1.3, int(n)).clip(0, 50_000).astype(np.uint32)) for k, n in enumerate([1, 700, 0, 512, 3, 2_300_000, 5, 1])]
    whole = np.concatenate([d for _, d in documents])
    file = token_files.FileReader(one_file(documents))
    assert file.total == len(whole) and file.number == 3 and file.keys.to_pylist() == list(range(8))
    for begin, end in ((0, len(whole)), (5, 5), (511, 513), (1_000_000, 1_000_001), (len(whole) - 7, len(whole))):
        assert (file.ids(begin, end) == whole[begin:end]).all()
    parts = [[] for _ in documents]
    for place, part in file.documents():
        parts[place].append(part)
        assert len(part) <= token_files.GROUP * token_files.BLOCK
    for got, (_, ids) in zip(parts, documents):
        assert (np.concatenate(got) if got else np.empty(0)).tolist() == ids.tolist()
    raw = one_file(documents)
    for broken in (raw[:-9], b"", b"PFR1" * 20):
        with pytest.raises(ValueError):
            token_files.FileReader(broken)


def brute_files(rows):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out, at = [], 0
    for key, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_the_library(spark, tmp_path):
    rows = odd_documents()
    folder = write(spark, tmp_path, rows)
    got = [tuple(r) for r in queries.op12_token_files(spark, folder).orderBy("start").collect()]
    order = {}
    # rows of one id come in an order of their own; ids ascend, null first
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    for r in rows:
        order.setdefault(r[0], []).append(r[1])
    want = Counter((k, n, c) for k, _, n, c in brute_files([(r[0], r[1]) for r in rows]))
    assert Counter((k, n, c) for k, _, n, c in got) == want
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_token_files_of_an_empty_table_and_of_text_ids(spark, tmp_path):
    empty = write(spark, tmp_path / "e", [])
    assert queries.op12_token_files(spark, empty).collect() == []
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), ("ä", "three")], "doc_id string, text string")
    token_files.write_files(docs, f"{tmp_path}/f", path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 0)
    got = token_files.read_files(spark, f"{tmp_path}/f", docs.schema["doc_id"].dataType).orderBy("start").collect()
    assert [r.doc_id for r in got] == ["a", "b", "ä"]


# alignment -----------------------------------------------------------------------------------------------------------

FILES = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[3])
    first.encode_special_tokens = True
    table = alignment.byte_alphabet()
    judged, total = [], Counter()
    for key, text in rows:
        made = None
        if text:
            e = first.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(table[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            b = []
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) == raw and b"".join(x for _, x in b) == raw:
                own = np.repeat(np.arange(len(a)), [len(x) for _, x in a])
                other = np.repeat(np.arange(len(b)), [len(x) for _, x in b])
                pairs = sorted(set(zip(own.tolist(), other.tolist())))
                ends = sorted(set(np.cumsum([len(x) for _, x in a]).tolist()) & set(np.cumsum([len(x) for _, x in b]).tolist()))
                texts, at = [], 0
                for end in ends:
                    texts.append("|".join(",".join(str(side[k][0]) for k in sorted(set(of[at:end].tolist()))) for side, of in ((a, own), (b, other))))
                    at = end
                links = [(a[x][0], b[y][0]) for x, y in pairs]
                total.update(links)
                made = (len(a), len(b), len(ends), links, hashlib.sha256(";".join(texts).encode()).hexdigest())
        judged.append((key, made))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    return Counter(
        (k, 0, 0, 0, 0, 0, 0, "") if m is None else (k, *m[:3], len(m[3]), sum(total[x] == most[x[1]] for x in m[3]), sum(total[x] for x in m[3]), m[4]) for k, m in judged
    )


def aligned(spark, folder):
    out = queries.op13_alignment(spark, folder)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("size", [1 << 21, 40])
def test_alignment_equals_brute_force_in_one_slice_or_many(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    rows = odd_documents()
    got = aligned(spark, write(spark, tmp_path, rows))
    assert got == brute_alignment([(r[0], r[1]) for r in rows])
    assert any(not k[1] and k[0] is not None for k in got) and any(k[4] > 1000 for k in got)


def test_alignment_of_an_empty_table(spark, tmp_path):
    assert not aligned(spark, write(spark, tmp_path, []))


@pytest.mark.parametrize("frame", [1, 7, 100, 1 << 20])
def test_long_documents_are_cut_at_group_ends(monkeypatch, frame):
    monkeypatch.setattr(alignment, "FRAME", frame)
    sides = alignment._sides(*FILES)
    texts = ["The quick brown fox jumps over the lazy dog, naïve café 日本語 1234 " * 3, "", "x", "antidisestablishmentarianism " * 5]
    got = [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist()))) for r in alignment.align(texts, sides)]
    monkeypatch.setattr(alignment, "FRAME", 1 << 24)
    assert got == [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist()))) for r in alignment.align(texts, sides)]


def test_links_of_random_tilings():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        starts = [np.concatenate([[0], 1 + np.flatnonzero(rng.random(size - 1) < rng.random())]) for _ in "ab"]
        own, other = (np.searchsorted(s, np.arange(size), side="right") - 1 for s in starts)
        assert sorted(zip(*(x.tolist() for x in alignment.links(*starts)))) == sorted(set(zip(own.tolist(), other.tolist())))


def test_sizes_prove_what_joined_bytes_prove(monkeypatch):
    sides = alignment.Sides(*FILES)
    assert sides.tiles
    texts = [r[1] or "" for r in odd_documents()]
    first = [[x.tolist() for x in sides.ids(t)] for t in texts]
    monkeypatch.setattr(sides, "tiles", False)
    assert first == [[x.tolist() for x in sides.ids(t)] for t in texts]


def test_alignment_adds_little_to_its_tokenizers():
    """Beyond both encoders an alignment takes less than three quarters of their time; merge joins and sorts by two keys took all of it."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aeiorstlnmcdu", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(300)]
    sides = alignment._sides(*FILES)

    def seconds(work):
        taken = []
        for _ in range(5):
            begin = time.process_time()
            work()
            taken.append(time.process_time() - begin)
        return min(taken)

    def encoders():
        for text in texts:
            bpe.encode(" " + text, sides.fast)
            sides.pieces.encode(text, num_threads=1)

    assert seconds(lambda: list(alignment.align(texts, sides))) < 1.75 * seconds(encoders)
