import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxloom.llm import token_files, warc
from voxloom.llm.shared import SharedFiles, Workspace

HARD = ["It's they'll 'tis  two  spaces \n\n x", "<|endoftext|> here", "日本語 text", "a b   c\x1c\x1d d", "é" * 50, "x" * 3000, " \t\n", "'''s 12345 ½ ²", "ĀɎ ɏ Ͱ"]


def test_encoder_is_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = token_files.Encoder(None)
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "B", "é", " ", " ", "\n", "\t", "'s", "7", ",", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for texts in (HARD, HARD, mixed, [], [""]):
        assert [np.frombuffer(x, encode.kind).tolist() for x in encode(pa.array(texts, pa.string()))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_output(docs, rows, spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = token_files.token_output(docs, seq_len=64).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter(want)
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == [i for i, _ in order]


def source_range(source):
    whole = source.read_buffer(source.size()) if source.seek(0) == 0 else None
    return whole.address, whole.address + whole.size


def test_sequences_by_number_without_a_copy(spark, docs, no_docs):
    work = Workspace(spark, "t")
    folder = work.folder("f")
    files = token_files.write_token_files(docs, folder, seq_len=32, flush=100).collect()
    assert sum(f["n_docs"] for f in files) == docs.count()
    for f in files:
        source = SharedFiles(folder).open(f["name"])
        table = pa.ipc.open_file(source).read_all()
        assert table["ids"].type.list_size == table["mask"].type.list_size == 32
        masks = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["mask"].chunks])
        assert masks.sum() == f["n_tokens"] and len(masks) % 32 == 0 and (np.diff(masks.astype(int)) <= 0).all()
        file = token_files.TokenFile(source)
        assert len(file) == table.num_rows
        for k in {0, len(file) // 2, len(file) - 1}:
            ids, mask = file[k]
            assert ids.to_pylist() == table["ids"][k].as_py() and mask.to_pylist() == table["mask"][k].as_py()
            start, end = source_range(source)
            assert start <= ids.buffers()[1].address < end
        with pytest.raises(IndexError):
            file[len(file)]
    assert token_files.token_output(no_docs).count() == 0


def pages(spark):
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "http://b", "<p>x</p>"), (None, "u", "<p>x</p>"), (7, "http://ü\r\nx", None), (8, "c", ""), (11, "d", "é\x00\r\n\r\nWARC/1.1" * 5000), (12, "e", "z")]
    return rows, spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, sha string, n long")


@pytest.mark.parametrize("min_bytes", [0, 8, 9])
def test_warc_round_trip(spark, min_bytes):
    rows, df = pages(spark)
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(df, min_bytes=min_bytes).collect())
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, k in rows if (k or "") == (h or "") and j is not None), default=None)
        again = i is not None and i > first and len(b) >= min_bytes
        want[i, u, len(b), warc.digest(b), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_archive_with_dictionary_and_damage():
    import struct

    import zstandard

    texts = [f"<html><body><p>page {i} of many pages with the same frame {i * i}</p></body></html>".encode() * 20 for i in range(300)]
    words = zstandard.train_dictionary(4096, texts).as_bytes()
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    frames = [c.compress(warc.record("response", i, "u", t, warc.digest(t))) for i, t in enumerate(texts[:20])]
    archive = struct.pack("<II", warc.DICT_MAGIC, len(words)) + words + b"".join(frames)
    assert [p for _, p, _ in warc.read_archive(archive)] == texts[:20]
    wrong = c.compress(warc.record("response", 1, "u", texts[0], warc.digest(b"other")))
    with pytest.raises(ValueError, match="payload"):
        list(warc.read_archive(archive + wrong))
    with pytest.raises(ValueError, match="bytes long"):
        list(warc.read_archive(archive + c.compress(warc.record("response", 1, "u", b"x", warc.digest(b"x"))[:-3])))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.read_archive(frames[0]))


def test_other_tokenizers_go_to_the_library_whole(tmp_path):
    import json

    import public_tokenizers
    import pyarrow as pa

    from voxloom.llm import token_files

    settings = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    assert token_files.splits_plainly(json.dumps(settings))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(settings | change))
        encode = token_files.Encoder(str(path))
        texts = ["Hello World, it's  me", "", "a\nb c"]
        assert encode(pa.array(texts)) == encode.ids(texts) != token_files.Encoder(None)(pa.array(texts))


def test_targets_are_percent_encoded_and_come_back():
    from urllib.parse import unquote

    from voxloom.llm import warc

    for url in ("http://a.b/c?d=e&f=%20#g", "http://ü.de/ß x\r\ny", "50%", ""):
        fields, _ = warc.headers(warc.record("response", 1, url, b"x", warc.digest(b"x")))
        assert unquote(fields["WARC-Target-URI"]) == url
