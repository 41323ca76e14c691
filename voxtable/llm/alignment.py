"""Cross-tokenizer alignment: two tokenizations of the same bytes, cut where tokens of both end.

Both tokenizers encode a space and the text; only texts that both give back byte for byte are aligned. Common ends are found by divide and
conquer: an interval of tokens is cut at the common end nearest to its middle token (each end of the one side is looked up among the
other's ends by bisection), both halves go on, and an interval without a common end inside is a leaf group. All intervals of
one depth, of all texts of a block, are worked on together.

Two tokens are linked where their bytes overlap, which happens inside a leaf group only. The number of documents that hold a pair of
ids linked is counted over the whole corpus. Texts come in blocks of bounded bytes; a block is written with its documents' links as
places in the block's list of different pairs. Only these lists meet the corpus-wide counts, and each block gets back its own
list, so no task and no executor ever holds the counts of the corpus, and a pair found in every text travels once a block.

Vocabularies are read on the driver from their paths and sent to the tasks; they are refused above ``max_bytes``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.llm.token_counts import PATTERN
from voxtable.session import staged

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_CODECS: dict[int, "Codec"] = {}


def byte_level_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranked_vocabulary(byte_level: bytes) -> dict[bytes, int] | None:
    """Ranks of a byte-level vocabulary whose merges go by id, so that a rank encoder gives the same ids; None for any other file."""
    told = json.loads(byte_level)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and told.get("normalizer") is None
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    alphabet, vocab = byte_level_alphabet(), model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t["content"] for t in told.get("added_tokens", ())}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    whole = merged == sorted(merged) and len(ranks) == len(merged) + 256 and all(bytes([b]) in ranks for b in range(256))
    return ranks if whole else None


class Codec:
    """A byte-level vocabulary (A) and a piece model (B), with the bytes of every id and its decimal form before each separator."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        ranks = ranked_vocabulary(byte_level)
        self.ranked = None if ranks is None else tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_level_alphabet()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        # A character outside of the alphabet is no byte: such an entry gives a byte sequence that no text equals.
        self.bytes_a = [bytes(alphabet[c] for c in entries[i]) if i in entries and all(c in alphabet for c in entries[i]) else b"" for i in range(max(entries, default=-1) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.wide = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [f"{i}{sep}" for sep in ",|;" for i in range(self.wide)]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def by_a(self, texts: list[str]) -> list[list[int]]:
        """Ids by A without special tokens. The rank encoder gives the ids of the vocabulary's own library (tested) in a quarter of its time."""
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of each text; none for both where one of them does not give back a space and the text."""
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        if not asked:
            return out
        by_a = self.by_a([" " + texts[i] for i in asked])
        by_b = self.b.encode([texts[i] for i in asked], num_threads=1)
        for i, a, b in zip(asked, by_a, by_b):
            whole = b" " + texts[i].encode()
            if b"".join([self.bytes_a[x] for x in a]) == whole == b"".join([self.bytes_b[x] for x in b]):
                out[i] = np.array(a, np.int64), np.array(b, np.int64)
        return out


def _codec(byte_level: bytes, pieces: bytes) -> Codec:
    key = hash((byte_level, pieces))
    if key not in _CODECS:
        _CODECS[key] = Codec(byte_level, pieces)
    return _CODECS[key]


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The groups between neighbouring common ends, as rows (first A, behind last A, first B, behind last B), in order.

    ``ends_a`` and ``ends_b`` are the byte offsets at which tokens end, rising over all texts of a block; each row of ``whole``
    is the interval of one text, whose last ends agree; together they cover all tokens.
    """
    # Tokens behind which a group ends, on either side; the ends of the texts to begin with.
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut_a[whole[:, 1] - 1] = cut_b[whole[:, 3] - 1] = True
    todo = whole
    while len(todo):
        a0, a1, b0, b1 = todo.T
        middle = (a0 + a1) // 2 - 1
        at = np.full(len(todo), -1)  # the A token whose end cuts the interval, and the B token with it
        with_b = np.full(len(todo), -1)
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        near = 0
        while len(open_):
            for side in (-1, 1) if near else (1,):
                p = middle[open_] + side * near
                inside = (p >= a0[open_]) & (p < a1[open_] - 1)
                asked, p = open_[inside], p[inside]
                found = np.searchsorted(ends_b, ends_a[p])
                hit = ends_b[found] == ends_a[p]
                at[asked[hit]], with_b[asked[hit]] = p[hit], found[hit]
                open_ = open_[at[open_] < 0]
            near += 1
            open_ = open_[(middle[open_] - near >= a0[open_]) | (middle[open_] + near < a1[open_] - 1)]
        cut = np.flatnonzero(at >= 0)
        at, with_b = at[cut] + 1, with_b[cut] + 1
        cut_a[at - 1] = cut_b[with_b - 1] = True
        halves = (np.stack([a0[cut], at, b0[cut], with_b], axis=1), np.stack([at, a1[cut], with_b, b1[cut]], axis=1))
        # Halves of one token on either side are leaves.
        todo = np.concatenate([h[(h[:, 1] - h[:, 0] > 1) & (h[:, 3] - h[:, 2] > 1)] for h in halves])
    to_a, to_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    return np.stack([np.r_[0, to_a][:-1], to_a, np.r_[0, to_b][:-1], to_b], axis=1)


def _ranges(first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    many = behind - first
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def links(groups: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) whose bytes overlap; they lie inside the leaf groups."""
    a0, a1, b0, b1 = groups.T
    plain = (a1 - a0 == 1) | (b1 - b0 == 1)  # one token meets all of the other side
    out_a, out_b = [], []
    for chosen in (a1 - a0 == 1, (a1 - a0 > 1) & (b1 - b0 == 1)):
        of_a, of_b = _ranges(a0[chosen], a1[chosen]), _ranges(b0[chosen], b1[chosen])
        out_a.append(np.repeat(of_a, (b1 - b0)[chosen]) if len(of_a) < len(of_b) else of_a)
        out_b.append(np.repeat(of_b, (a1 - a0)[chosen]) if len(of_b) < len(of_a) else of_b)
    a0, a1, b0, b1 = groups[~plain].T
    token = _ranges(a0, a1)
    if len(token):
        # No end inside is common, so an A token starts in the B token in which the one before it ends.
        to = np.searchsorted(ends_b, ends_a[token])
        since = np.r_[0, to[:-1]]
        opens = np.cumsum(a1 - a0) - (a1 - a0)
        since[opens] = b0
        out_a.append(np.repeat(token, to - since + 1))
        out_b.append(_ranges(since, to + 1))
    return np.concatenate(out_a), np.concatenate(out_b)


def _digests(codec: Codec, groups: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text; ``sizes`` are the tokens of both sides by text."""
    a0, a1, b0, b1 = groups.T
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    sep_a, sep_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sep_a[a1 - 1], sep_b[b1 - 1] = 1, 2
    order[np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)] = ids_a + sep_a * codec.wide
    order[np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)] = ids_b + sep_b * codec.wide
    out, at, names = [], 0, codec.names
    for n in sizes.tolist():
        text = "".join([names[i] for i in order[at : at + n].tolist()])
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
        at += n
    return out


def aligned(texts: list[str | None], codec: Codec) -> dict:
    """A block of texts: their counts and digests, the block's different pairs (A id in the upper half), and each text's links as places in them."""
    ids_a, ids_b = [], []
    at = 0
    while at < len(texts):  # encodings take far more room than ids
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= 1 << 18):
            size += len(texts[stop] or "")
            stop += 1
        for a, b in codec.encode(texts[at:stop]):
            ids_a.append(a)
            ids_b.append(b)
        at = stop
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    none = np.zeros(0, np.int64)
    every_a, every_b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    ends_a, ends_b = np.cumsum(codec.size_a[every_a]), np.cumsum(codec.size_b[every_b])
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    whole = np.stack([to_a - n_a, to_a, to_b - n_b, to_b], axis=1)
    groups = leaf_groups(ends_a, ends_b, whole[n_a > 0])
    owner = np.repeat(np.arange(len(texts)), n_a)
    of_group = owner[groups[:, 0]]
    link_a, link_b = links(groups, ends_a, ends_b)
    of_link = owner[link_a]
    pairs, place = np.unique(every_a[link_a] << 32 | every_b[link_b], return_inverse=True)
    del link_a, link_b, ends_a, ends_b
    held, times = np.unique(of_link * len(pairs) + place, return_counts=True)
    of_held = held // len(pairs) if len(pairs) else held
    place = held - of_held * len(pairs)
    edges = np.searchsorted(of_held, np.arange(len(texts) + 1))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of_group, minlength=len(texts)), "n_links": np.bincount(of_link, minlength=len(texts)),
        "groups_sha256": _digests(codec, groups, every_a, every_b, n_a + n_b), "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)),
        "places": [place[i:j] for i, j in zip(edges, edges[1:])], "times": [times[i:j] for i, j in zip(edges, edges[1:])],
    }


_BLOCKS = "block bigint, listed boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _with_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int, max_bytes: int) -> DataFrame:
    """One row for each document, and one ``listed`` row for each block: its different pairs and in how many documents each is."""
    data = [Path(p).read_bytes() for p in (path_a, path_b)]
    if sum(map(len, data)) > max_bytes:
        raise ValueError(f"vocabularies of {sum(map(len, data))} bytes; at most {max_bytes} are sent to the tasks")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    own = docs.select("doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part_of = _codec(*sent.value), TaskContext.get().partitionId()
        for number, part in enumerate(rows.slices(batches, "text", block_bytes)):
            got = aligned(part.column("text").to_pylist(), codec)
            n, block = part.num_rows, part_of << 32 | number
            ids = pa.concat_arrays([part.column("doc_id"), pa.nulls(1, part.column("doc_id").type)])
            packed = [[*(x.astype("<u4").tobytes() for x in got["places"]), got["pairs"].astype("<i8").tobytes()], [*(x.astype("<u4").tobytes() for x in got["times"]), got["docs"].astype("<u4").tobytes()]]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([block] * (n + 1), pa.int64()), pa.array([False] * n + [True]), *[pa.array([*got[c].tolist(), None], pa.int64()) for c in _COUNTS],
                pa.array([*got["groups_sha256"], None], pa.string()), *[pa.array(p, pa.binary()) for p in packed]], names=["doc_id", "block", "listed", *_COUNTS, "groups_sha256", "places", "times"])

    fields = {k: v for k, v in (f.split(" ") for f in _BLOCKS.split(", "))}
    return staged(own.mapInArrow(work, rows.widened(own.select("doc_id"), **fields)), "aligned")


def _listed_pairs(blocks: DataFrame) -> DataFrame:
    """``block``, ``place``, ``pair``, ``docs``: the lists of the blocks as rows."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*[c.to_pylist() for c in batch.columns]):
                pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<u4").astype(np.int64)
                for at in range(0, len(pairs), 1 << 16):
                    p, d = pairs[at : at + (1 << 16)], docs[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.array(np.arange(at, at + len(p))), pa.array(p), pa.array(d)], names=["block", "place", "pair", "docs"])

    return blocks.where("listed").select("block", "places", "times").mapInArrow(unpack, "block bigint, place bigint, pair bigint, docs bigint")


def align(docs: DataFrame, *, path_a: str = BYTE_LEVEL, path_b: str = PIECES, block_bytes: int = 1 << 20, max_bytes: int = 1 << 26) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` for every row of ``docs``.

    Null and empty texts, and texts that one of the tokenizers does not give back, have zeros and an empty digest. Repeated rows are
    documents of their own, null ids too. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    blocks = _with_blocks(docs, path_a, path_b, block_bytes, max_bytes)
    pairs = _listed_pairs(blocks)
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = staged(counts, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    known = counts.join(highest.hint("merge"), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answered = pairs.join(known.hint("merge"), "pair").select("block", "place", "count", "best")
    per_doc = blocks.where("NOT listed").drop("listed")
    both = per_doc.unionByName(answered, allowMissingColumns=True)
    # A block's answers come before its documents.
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("place").isNull(), "place")
    columns = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best = None, [], []
        for batch in batches:
            block = batch.column("block").to_numpy()
            listed = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
            # Runs of one block and one kind.
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (listed[1:] != listed[:-1]), True])
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                if block[lo] != now:
                    now, counts, best = block[lo], [], []
                if listed[lo]:
                    counts.append(part.column("count").to_numpy())
                    best.append(part.column("best").to_numpy(zero_copy_only=False))
                    continue
                every, top = (x if isinstance(x, np.ndarray) else np.concatenate([np.zeros(0, k), *x]) for x, k in ((counts, np.int64), (best, bool)))
                counts, best = every, top
                sums, tops = [], []
                for place, times in zip(part.column("places").to_pylist(), part.column("times").to_pylist()):
                    place, times = np.frombuffer(place, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
                    sums.append(int((every[place] * times).sum()))
                    tops.append(int(times[top[place]].sum()))
                yield rows.with_columns(part, ["doc_id", *_COUNTS], n_best=pa.array(tops, pa.int64()), count_sum=pa.array(sums, pa.int64()), groups_sha256=part.column("groups_sha256"))

    schema = rows.widened(docs.select("doc_id"), **{c: "bigint" for c in columns[1:-1]}, groups_sha256="string")
    return dealt.mapInArrow(settle, schema)


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(rows.table(spark, sf_dir, "documents"))
