"""BPE encoding and decoding with an index of pair occurrences.

A task collects the words of a slice of its rows that it has not met yet, lays their symbols out in one linked list and
maps each pair of neighbours that has a rank to all its positions. The lowest active rank is taken, all its positions
are merged from left to right, and the lists of the pairs that vanish or arise beside them are updated; then the next
rank. Words that were met keep their ids in a table of bounded size. Decoding looks each id's token up again.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import small_batches, table

#: Most words and white-space-free runs whose ids a worker keeps; beyond it the table starts anew.
KEEP = 300_000
#: UTF-8 bytes of text that one slice of rows and one output batch hold, unless one text alone is longer.
SLICE = 2_000_000

#: White space to the tokenizer.
_SPACE = "".join(map(chr, (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
_RUN = regex.compile(f"[^{_SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")  # str.split() splits at these, the tokenizer does not
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.split_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        self.last_id = np.array([vocab[s + self.end] for s in symbols], np.int64)
        #: left << 16 | right -> rank << 16 | merged; ids and ranks both stay below 65,536.
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a] << 16 | vocab[b]] = rank << 16 | vocab[a + b]
        if max(len(self.tokens), len(model["merges"])) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 tokens are not read")
        self.pairs = {found >> 16: (pair >> 16, pair & 0xFFFF, found & 0xFFFF) for pair, found in self.ranks.items()}
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] >> 16 for k in self.keys.tolist()], np.int64)
        made: dict[int, int] = {}
        for found in self.ranks.values():
            made[found & 0xFFFF] = max(found >> 16, made.get(found & 0xFFFF, -1))
        #: Whether a pair always ranks after the merges that make its parts; then one pass a rank is exact.
        self.ordered = all(made.get(x, -1) < found >> 16 for pair, found in self.ranks.items() for x in (pair >> 16, pair & 0xFFFF))

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by one index of pair occurrences over all of them."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        symbols[ends - 1] = self.last_id[[w[-1] for w in words]]
        n = len(symbols)
        # The index: for each rank the positions of its pair, in ascending order.
        pair = symbols[:-1] << 16 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        there = self.keys[at] == pair
        there[ends[:-1] - 1] = False
        places = np.flatnonzero(there)
        rank_at = self.key_ranks[at[places]]
        order = np.argsort(rank_at, kind="stable")
        cut = np.flatnonzero(np.diff(rank_at[order])) + 1
        firsts = rank_at[order[np.concatenate([[0], cut])]].tolist() if len(order) else []
        index = dict(zip(firsts, (x.tolist() for x in np.split(places[order], cut)), strict=True)) if firsts else {}
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        sym, after, before, ends = symbols.tolist(), after.tolist(), before.tolist(), ends.tolist()
        get, ordered = self.ranks.get, self.ordered
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank)
            left, right, whole = self.pairs[rank]
            places.sort()
            as_left = whole << 16
            for at, i in enumerate(places):
                if sym[i] != left or (j := after[i]) < 0 or sym[j] != right:
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j], after[i] = whole, -1, k
                lower = False
                if k >= 0:
                    before[k] = i
                    if found := get(as_left | sym[k]):
                        new = found >> 16
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(active, new)
                        lower = new < rank
                if h >= 0 and (found := get(sym[h] << 16 | whole)):
                    new = found >> 16
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(active, new)
                    lower |= new < rank
                if lower and not ordered and at + 1 < len(places):  # the lower rank goes first
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank].extend(places[at + 1 :])
                    break
        out, start = [], 0
        for e in ends:
            out.append([s for s in sym[start:e] if s >= 0])
            start = e
        return out


class Splitter:
    """The words of runs without white space, normalised, in UTF-8.

    Beyond the Latin blocks, where tables of letters differ between versions of Unicode, the tokenizers library's own splitting and
    normalising decide; nothing is encoded by it.
    """

    def __init__(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(
            Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior="removed", invert=True
        )

    def __call__(self, run: str) -> list[bytes]:
        if not run.isascii():
            if max(run) > "\u024f":
                return [w.encode("utf-8", "surrogatepass") for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(run))]
            run = unicodedata.normalize("NFC", run)
        run = run.lower()
        if run.isalpha():
            return [run.encode()]
        if run[:-1].isalpha() and not run[-1].isalnum():
            return [run[:-1].encode(), run[-1].encode()]
        return [p.encode() for p in _PIECE.findall(run)]


class Encoder:
    def __init__(self, path: str, keep: int = KEEP):
        self.vocabulary, self.keep, self.split = Vocabulary(path), keep, Splitter()
        self.decimal = [str(i) for i in range(len(self.vocabulary.tokens))]
        self.of_piece: dict[bytes, bytes] = {}
        self.of_run: dict[str, bytes] = {}
        self.special = {t: np.int32(i).tobytes() for t, i in self.vocabulary.special.items()}

    def _runs(self, text: str) -> list[str]:
        return _RUN.findall(text) if _ODD.search(text) else text.split()

    def _parts(self, text: str) -> list[str]:
        """Runs without white space; a special token's text stands by itself."""
        if self.vocabulary.split_special is None or not any(s in text for s in self.special):
            return self._runs(text)
        return [r for k, part in enumerate(self.vocabulary.split_special.split(text)) for r in ([part] if k % 2 else self._runs(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        parts = [self._parts(t) if t else [] for t in texts]
        if len(self.of_run) > self.keep:
            self.of_run.clear()
        if len(self.of_piece) > self.keep:
            self.of_piece.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.of_run, self.special)
        split = {r: self.split(r) for r in new}
        unseen = list({w for ws in split.values() for w in ws if w not in self.of_piece})
        for w, ids in zip(unseen, self.vocabulary.merge(unseen), strict=True):
            self.of_piece[w] = np.array(ids, np.int32).tobytes()
        for r, ws in split.items():
            self.of_run[r] = b"".join([self.of_piece[w] for w in ws])
        look = self.of_run
        for token, ids in self.special.items():
            look[token] = ids
        return [b"".join(map(look.__getitem__, p)) for p in parts]

    def digest(self, ids: bytes) -> tuple[str, str]:
        """SHA-256 of the ids in decimal, joined by spaces, and of the decoded text."""
        numbers = " ".join(map(self.decimal.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    def decode(self, ids: bytes | list[int]) -> str:
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in (np.frombuffer(ids, np.int32).tolist() if isinstance(ids, bytes) else ids)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, ids (array of int), decoded: a row for each row of df; with ``digest`` what digests() makes of them instead.

    ``path`` is a tokenizer file that every worker can open: word-level BPE with a word end, lower case, white space
    dropped. Null texts count as empty: no ids, and an empty decoded text. Nulls in the id and repeated rows pass
    through. Only the named columns are read, so others cannot clash; an empty table gives no rows.
    """
    small_batches(df)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            start = 0
            while start < len(batch):
                end, size, part = start, 0, []
                while end < len(batch) and (end == start or size < SLICE):
                    t = texts[end].as_py()
                    size += len(t or "")
                    part.append(t)
                    end += 1
                coded = coder.encode(part)
                if digest:  # made here, ids and decoded texts need not travel to the JVM
                    made = [coder.digest(c) for c in coded]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(start, end - start),
                            pa.array([len(c) // 4 for c in coded], pa.int64()),
                            pa.array([m[0] for m in made]),
                            pa.array([m[1] for m in made]),
                        ],
                        names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                    start = end
                    continue
                values = pa.array(np.frombuffer(b"".join(coded), np.int32), pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32), pa.int32())
                decoded = pa.array([coder.decode(c) for c in coded], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.ListArray.from_arrays(offsets, values), decoded], names=["id", "ids", "decoded"]
                )
                start = end

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"id {id_type}, ids array<int>, decoded string",
    )
    return out.withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)
