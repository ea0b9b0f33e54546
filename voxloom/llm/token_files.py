"""Token-ID output: Arrow stream-file format with fixed-size-list batches.

A file holds record batches of ``ids: fixed_size_list<uint16 or uint32>[seq_len]`` (by the size of the
vocabulary) and ``mask: fixed_size_list<bool>[seq_len]`` (true where an id stands, false after the last one), so a memory-mapped file gives any sequence by its number without a
copy. A second small file names the documents in it: ``doc_id, at`` (place of the first id), ``n_tokens``.
Sequences run on over documents, each of which ends with ``end_id``.

Documents are range-partitioned by id, a partition writes one pair of files, and the partitions' totals give
each file's place in the whole. Files are written in the shared folder under a temporary name and renamed, so a
lost executor's task can run again. Ids of one file only are in memory, in pieces of ``flush`` ids.

Ids are the tokenizer library's. The byte-level model encodes each piece of the vocabulary's own split on its
own, so pieces (or whole runs between spaces, where no space is next to other white space) go to the library
once for some megabytes of text, and frequent ones into a bounded cache of each Python worker. Texts with characters
beyond ``PLAIN`` or with the name of a special token go to the library whole, and so do all texts where the tokenizer
file asks for another split, a normaliser or the like.

Defined results: null text is an empty one (its end id only); a null id sorts first and stays null; repeated
rows are repeated documents; an empty table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFiles, Workspace, doc_id, null_id, worker

SEQ_LEN, END_ID = 2048, 0
#: The public split pattern of this vocabulary, and text in which both regex engines agree on it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEYOND_PLAIN = r"[^\t\n\r -~¡-¬®-ɏ]"
#: Where none of these occurs, a space always opens the piece that follows it, so a text can be split at spaces.
AROUND_SPACE = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
#: Stands for the space in the names of byte-level ids.
SPACE_MARK = "Ġ"
CACHED, CACHED_CHARS, TEXT_CHARS = 150_000, 40, 1 << 22
#: Settings of a tokenizer file under which the split above is the tokenizer's own and nothing else acts.
PLAIN_FILE = {"normalizer": None, "post_processor": None, "truncation": None, "padding": None}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}


def splits_plainly(settings: str) -> bool:
    """Whether a tokenizer's own split is ``SPLIT``, with nothing before or after it."""
    import json

    found = json.loads(settings)
    split, model = found.get("pre_tokenizer") or {}, found.get("model") or {}
    return (
        all(found.get(k) == v for k, v in PLAIN_FILE.items()) and all(split.get(k) == v for k, v in PLAIN_SPLIT.items())
        and all(model.get(k) == v for k, v in PLAIN_MODEL.items())
    )


class Encoder:
    """``texts`` (an Arrow array) ``-> bytes`` of each one's little-endian ids, 16 bits wide where the vocabulary allows, else 32."""

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_pieces = splits_plainly(self.tokenizer.to_str())
        self.pieces = regex.compile(SPLIT).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.beyond = "|".join([BEYOND_PLAIN, *map(re.escape, special)])
        marked = [i for t, i in self.tokenizer.get_vocab().items() if t[:1] == SPACE_MARK]
        self.opens = None
        if marked:
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.opens[marked] = True
        self.cache: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each part on its own. Those with a space before them and no white space in them go to the library
        by lines of 64: there just their first ids have the space's mark."""
        import numpy as np

        lined = [k for k, w in enumerate(words) if w and w[0] != "\0" and not ("\n" in w or "\t" in w or "\r" in w)] if self.opens is not None else []
        lines = [" " + " ".join([words[k] for k in lined[i : i + 64]]) for i in range(0, len(lined), 64)]
        ids = np.frombuffer(b"".join(self.ids(lines)), self.kind)
        starts = np.flatnonzero(self.opens[ids]) if lines else []
        if len(starts) != len(lined):
            lined, starts = [], []
        out: list = [None] * len(words)
        raw, size = ids.tobytes(), self.kind.itemsize
        at = [*(size * np.asarray(starts, np.int64)).tolist(), len(raw)]
        for k, a, z in zip(lined, at, at[1:], strict=False):
            out[k] = raw[a:z]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.ids([words[k][1:] if words[k][:1] == "\0" else " " + words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def of_parts(self, parts):
        """Ids of an Arrow array of parts, one after the other, and how many each has.

        A part gets a space before it, unless it starts with a NUL (no text that gets here has one), which goes.
        Only distinct parts come to Python."""
        import numpy as np

        coded = parts.dictionary_encode()
        where, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.cache) > CACHED:
            self.cache.clear()
        found = list(map(self.cache.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        often = np.bincount(where, minlength=len(words)) > 1
        for i, x in zip(new, self.of_words([words[i] for i in new]), strict=True):
            found[i] = x
            if often[i] and len(words[i]) <= CACHED_CHARS:
                self.cache[words[i]] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(found), self.kind)
        sizes_of, starts = sizes[where], (np.cumsum(sizes) - sizes)[where]
        at = np.cumsum(sizes_of) - sizes_of
        take = np.repeat((starts - at).astype(np.int32 if len(pool) + at[-1:].sum() < 1 << 30 else np.int64), sizes_of)
        take += np.arange(len(take), dtype=take.dtype)
        return pool[take], sizes_of

    def __call__(self, texts) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_pieces:
            return self.ids(texts.to_pylist())
        whole = pc.match_substring_regex(texts, self.beyond).to_numpy(zero_copy_only=False)
        tight = pc.match_substring_regex(texts, "|".join(AROUND_SPACE)).to_numpy(zero_copy_only=False) & ~whole
        out: list = [None] * len(texts)
        for k, x in zip(np.flatnonzero(whole), self.ids(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            out[k] = x
        plain = ~whole & ~tight
        text = pc.binary_join_element_wise("\0", texts.filter(pa.array(plain)), "")
        text = pc.replace_substring_regex(text, r"(\p{L})([^\p{L}\p{N}\s'\x00])", "\\1 \0\\2")  # a piece always ends there
        text = pc.replace_substring_regex(text, r"([^\s\x00])\n([^\s\x00])", "\\1 \0\n \0\\2")
        split = [pc.split_pattern(text, " ")]
        split.append(pa.array([["\0" + x for x in self.pieces(t)] for t in texts.filter(pa.array(tight)).to_pylist()], pa.list_(pa.string())))
        for docs, lists in zip((plain, tight), split, strict=True):
            if len(lists):
                ids, sizes = self.of_parts(lists.flatten())
                ends = np.r_[0, np.cumsum(sizes)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
                for k, a, z in zip(np.flatnonzero(docs), ends, ends[1:], strict=False):
                    out[k] = ids[a:z].tobytes()
        return out


def _encoder(path: str | None, made: dict = {}) -> Encoder:  # noqa: B006  one per Python worker
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def _sequences(chunks: Iterator[bytes], dtype, seq_len: int, sink, flush: int) -> None:
    """Write batches of whole sequences from pieces of ids, the last padded with 0 and masked."""
    import numpy as np
    import pyarrow as pa

    kinds = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
    with pa.ipc.new_file(sink, kinds) as out:

        def put(ids, mask) -> None:
            both = [pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (ids, mask)]
            out.write_batch(pa.record_batch(both, schema=kinds))

        held, size = [], 0
        for c in chunks:
            held.append(c)
            size += len(c)
            if size >= dtype.itemsize * max(flush, seq_len):
                all_ids = np.frombuffer(b"".join(held), dtype)
                whole = len(all_ids) // seq_len * seq_len
                put(all_ids[:whole], np.ones(whole, bool))
                held, size = [all_ids[whole:].tobytes()], dtype.itemsize * (len(all_ids) - whole)
        rest = np.frombuffer(b"".join(held), dtype)
        if len(rest):
            whole = -(-len(rest) // seq_len) * seq_len
            ids, mask = np.zeros(whole, dtype), np.zeros(whole, bool)
            ids[: len(rest)], mask[: len(rest)] = rest, True
            put(ids, mask)


class TokenFile:
    """Sequences of one file by number: ``(ids, mask)`` as views of the file's memory, nothing is copied."""

    def __init__(self, source):
        import numpy as np
        import pyarrow as pa

        reader = pa.ipc.open_file(source)
        self.batches = [reader.get_batch(k) for k in range(reader.num_record_batches)]
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, k: int):
        import numpy as np

        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, "right"))
        batch, row = self.batches[at], k - (int(self.ends[at - 1]) if at else 0)
        size = batch["ids"].type.list_size
        return (batch[c].values.slice((batch[c].offset + row) * size, size) for c in ("ids", "mask"))


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, flush: int = 1 << 18) -> DataFrame:
    """Writes the files; ``part, name, index, n_docs, n_tokens`` of each. Run its plan once (``listed`` does)."""

    def write(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        batches = chain([first], batches)

        part, encode = TaskContext.get().partitionId(), _encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        ids, counts = [], []

        def chunks():
            for b in batches:
                ids.extend(b["doc_id"].to_pylist())
                sizes = np.cumsum(pc.utf8_length(b["text"]).to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(np.diff(sizes // TEXT_CHARS, prepend=-1))  # texts of about 4 MB at once
                for a, z in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                    for x in encode(b["text"][a:z]):
                        counts.append(len(x) // len(end) + 1)
                        yield x
                        yield end

        shared = SharedFiles(folder)
        with shared.create(f"tokens-{part:06d}.arrow") as to:
            _sequences(chunks(), encode.kind, seq_len, pa.PythonFile(to, "w"), flush)
        n = np.array(counts, np.int64)
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "at": np.cumsum(n) - n, "n_tokens": n})
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        shared.write(f"index-{part:06d}.arrow", [out.getvalue().to_pybytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [f"tokens-{part:06d}.arrow"], "index": [f"index-{part:06d}.arrow"], "n_docs": [len(ids)], "n_tokens": [int(n.sum())]})

    rows = docs.select(doc_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(worker(write), "part long, name string, index string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """From the files that ``write_token_files`` listed: ``doc_id, start, n_tokens, ids_crc32``."""
    before = files.groupBy("part").agg(F.first("n_tokens").alias("n"), F.first("name").alias("name"), F.first("index").alias("index"))
    totals = [(r["part"], r["n"]) for r in before.select("part", "n").orderBy("part").collect()]  # one small row for each file
    starts, at = {}, 0
    for part, n in totals:
        starts[part], at = at, at + n

    def read(batches):
        import numpy as np
        import pyarrow as pa

        shared = SharedFiles(folder)
        for b in batches:
            for part, name, index in zip(*(b[c].to_pylist() for c in ("part", "name", "index")), strict=True):
                with shared.open(index) as f:
                    docs = pa.ipc.open_file(f).read_all()
                with shared.open(name) as f:
                    tokens = pa.ipc.open_file(f)
                    crc, left = [0] * docs.num_rows, docs["n_tokens"].to_pylist()
                    k = 0
                    for j in range(tokens.num_record_batches):
                        batch = tokens.get_batch(j)
                        ids = batch["ids"].flatten().to_numpy()
                        ids = ids[: batch["mask"].flatten().true_count]  # only the end is masked
                        view, p = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                        while p < len(ids):
                            take = min(left[k], len(ids) - p)
                            crc[k] = zlib.crc32(view[4 * p : 4 * (p + take)], crc[k])
                            left[k] -= take
                            p += take
                            k += not left[k]
                if any(left) or k != docs.num_rows:
                    raise ValueError(f"{name} doesn't hold the ids that {index} lists")
                yield pa.RecordBatch.from_arrays(
                    [docs["doc_id"].combine_chunks(), pa.array(docs["at"].to_numpy() + starts[part]), docs["n_tokens"].combine_chunks(), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n_tasks = max(1, min(len(totals), 4 * files.sparkSession.sparkContext.defaultParallelism))
    out = files.select("part", "name", "index").repartition(n_tasks).mapInArrow(worker(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", null_id(F.col("doc_id")))


def token_output(docs: DataFrame, *, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back, a row for each document."""
    work = Workspace(docs.sparkSession, "tokens")
    folder = work.folder("files")
    files = work.listed(write_token_files(docs, folder, tokenizer=tokenizer, seq_len=seq_len, end_id=end_id))
    return read_token_files(files, folder)
