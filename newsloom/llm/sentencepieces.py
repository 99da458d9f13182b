"""Operator 13: encoding to and decoding from the ids of a SentencePiece BPE model, by vectorised merge rounds.

A batch of texts becomes one byte buffer, with the model's leading space before each text. It is cut before every space that
follows something else, since no piece of the model reaches across such a place, and each distinct word is merged
once. All of them are one flat array of symbols: every round looks up the piece that each adjacent pair makes, takes the least rank of each word by
a segmented minimum, merges all leftmost pairs of that rank at once, and compacts the array; words without a pair
leave it, until none is left. The library merges one pair at a time, best score and then leftmost first. Both agree
as long as a merge makes no pair of a better score than its own; pieces for which the vocabulary allows that are marked, and of
those only the leftmost pair of a word is merged in a round. A word of more than `LONG` symbols, for which rounds
would cost their number times its length, is merged pair by pair with a heap, in the same order.

Decoding joins the bytes of the pieces; runs of byte pieces are read as UTF-8, where each byte that is not part of
a character becomes U+FFFD, and one leading space goes.

Nothing is shuffled: texts are encoded where they are read, and the model file is read by each worker process.

Cases: null and empty texts have no ids and decode to the empty text. Bytes that are no UTF-8 count as U+FFFD. Characters without a piece
become byte pieces; the unknown piece's id, which no text gives then, decodes to the model's mark, control ids to nothing,
and ids outside of the vocabulary and nulls among ids raise an error. Ids that are null decode to null. Strings that spell a control or byte piece are ordinary text.
Very long texts and words are encoded whole. Repeated rows, null ids of documents and empty tables pass through.
Other columns, of any name, travel in the struct column `rest`.
Models must be BPE with byte fallback, leave texts unnormalised but for the leading space, and have no user-defined
or unused pieces; others raise an error.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.distinct import distinct, spread
from newsloom.llm.exchange import framed, loose
from newsloom.llm.tokens import slices, text_buffers

SPACE = "▁"
LONG = 4096
NONE = np.iinfo(np.int32).max
CODES = 0x110000
TABLE = 20

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _place(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).astype(np.int64)


class Pieces:
    """The vocabulary of a model file: symbols of characters, the piece that each pair makes, ranks, bytes of pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with byte fallback and a leading space, without normalisation")
        kinds = np.array([p.type for p in model.pieces])
        if np.isin(kinds, [kind.USER_DEFINED, kind.UNUSED]).any():
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if SPACE not in normal or any(b == SPACE != a for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("the model must have a piece for the space, and none with a space behind another character")
        # Symbols: ids of pieces, then characters that only stand inside of pieces, then all other characters by code.
        inner = sorted({c for p in normal for c in p} - set(normal))
        self.size = len(model.pieces)
        self.symbols = self.size + len(inner)
        self.code = np.arange(CODES, dtype=np.int64) + self.symbols
        for c, i in [*((p, i) for p, i in normal.items() if len(p) == 1), *((c, self.size + k) for k, c in enumerate(inner))]:
            self.code[ord(c)] = i
        self.inner = np.array([ord(c) for c in inner], np.int64)
        self.code[0x20] = self.code[ord(SPACE)]
        scores = np.array([p.score for p in model.pieces], np.float32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        symbol = {c: int(self.code[ord(c)]) for p in normal for c in p} | normal
        pairs, risky = {}, np.zeros(self.size, bool)
        for whole, i in normal.items():
            for k in range(1, len(whole)):
                a, b = symbol.get(whole[:k]), symbol.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a * (self.symbols + CODES) + b] = i
                    for part in (a, b):
                        if part < self.size and self.rank[part] >= self.rank[i]:
                            risky[part] = True
        self.pairs, self.risky = pairs, risky
        self._index(np.array([*pairs, -1], np.int64), np.array([*pairs.values(), -1], np.int64))
        self.byte = np.full(256, -1, np.int64)
        self.of_byte = np.full(self.size, -1, np.int64)
        self.leads = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[3:-1], 16)], self.of_byte[i] = i, int(p.piece[3:-1], 16)
            surface.append(model.trainer_spec.unk_surface if p.type == kind.UNKNOWN else "" if p.type in (kind.CONTROL, kind.BYTE) else p.piece.replace(SPACE, " "))
        self.surface = [s.encode() for s in surface]
        for i in np.flatnonzero(self.of_byte >= 0).tolist():
            self.surface[i] = bytes([self.of_byte[i]])

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A table of pairs by hash; of pairs that share a place all but one are in a sorted list beside it."""
        self.keys, self.made = keys, made
        self.table, self.more = np.full(1 << TABLE, len(keys) - 1, np.int32), np.zeros(1 << TABLE, bool)
        place = _place(keys)
        self.table[place] = np.arange(len(keys))
        rest = np.flatnonzero(self.table[place] != np.arange(len(keys)))
        self.more[place[rest]] = True
        order = rest[np.argsort(keys[rest])]
        self.rest_keys, self.rest_made = keys[order], made[order]

    def made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or -1."""
        key = left * (self.symbols + CODES) + right
        place = _place(key)
        at = self.table[place]
        out = np.where(self.keys[at] == key, self.made[at], -1)
        maybe = np.flatnonzero((out < 0) & self.more[place])
        if len(maybe):
            found = np.minimum(np.searchsorted(self.rest_keys, key[maybe]), len(self.rest_keys) - 1)
            out[maybe] = np.where(self.rest_keys[found] == key[maybe], self.rest_made[found], -1)
        return out

    def merged_alone(self, word: list[int]) -> list[int]:
        """One word, pair by pair: best score first, then the leftmost."""
        after, before, base = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)], self.symbols + CODES
        rank = self.rank.tolist()
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            made = self.pairs.get(word[i] * base + word[j]) if i >= 0 and j >= 0 else None
            if made is not None:
                heapq.heappush(heap, (rank[made], i, word[i], word[j], made))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j < 0 or word[j] != b:
                continue
            word[i], word[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in word if x >= 0]

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, one after another, after all merges, and how many each word has left."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, sizes, symbols of words that are done
        word = np.arange(len(sizes))
        starts = np.cumsum(sizes) - sizes
        for w in np.flatnonzero(sizes > LONG).tolist():
            own = np.array(self.merged_alone(symbols[starts[w] : starts[w] + sizes[w]].tolist()), np.int64)
            out.append((word[w : w + 1], np.array([len(own)]), own))
        short = sizes <= LONG
        symbols, word, sizes = symbols[np.repeat(short, sizes)], word[short], sizes[short]
        made = np.full(len(symbols), -1)
        made[:-1] = self.made_by(symbols[:-1], symbols[1:])
        made[np.cumsum(sizes) - 1] = -1
        rank = np.where(made >= 0, self.rank[made], NONE)
        while len(word):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                out.append((word[~live], sizes[~live], symbols[~stay]))
                symbols, made, rank, word, sizes, least = symbols[stay], made[stay], rank[stay], word[live], sizes[live], least[live]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            # Of each run of overlapping pairs every other one, from the left; of risky pieces the first of the word.
            best = np.flatnonzero(rank == np.repeat(least, sizes))
            head = np.concatenate([[True], np.diff(best) > 1])
            chosen = best[(np.arange(len(best)) - np.maximum.accumulate(np.where(head, np.arange(len(best)), 0))) % 2 == 0]
            risky = self.risky[made[chosen]]
            if risky.any():
                own = np.searchsorted(starts, chosen, "right") - 1
                held = np.zeros(len(word), bool)
                held[own[risky]] = True
                leftmost = np.concatenate([[True], own[1:] != own[:-1]])
                chosen = chosen[leftmost | ~held[own]]
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, made, rank, sizes = symbols[keep], made[keep], rank[keep], np.add.reduceat(keep, starts, dtype=np.int64)
            # Pairs to either side of what was merged are new; the others stand.
            now = chosen - np.arange(len(chosen))
            new = np.concatenate([now, now[now > 0] - 1])
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            new = new[~last[new]]
            rank[now], made[now] = NONE, -1
            made[new] = self.made_by(symbols[new], symbols[new + 1])
            rank[new] = np.where(made[new] >= 0, self.rank[made[new]], NONE)
        words, counts, flat = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.argsort(words, kind="stable")
        return flat[spread((np.cumsum(counts) - counts)[order], counts[order])], counts[order]

    def ids(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after another in raw, UTF-8 bytes, and how many each word has."""
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(sizes)
        symbols, counts = self.merged(self.code[codes], lead[ends] - lead[ends - sizes])
        odd = symbols >= self.size
        if not odd.any():
            return symbols, counts
        code = np.where(symbols[odd] >= self.symbols, symbols[odd] - self.symbols, 0)
        inner = symbols[odd] < self.symbols
        code[inner] = self.inner[symbols[odd][inner] - self.size]
        spelt = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
        width = np.ones(len(symbols), np.int64)
        width[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(symbols, width)
        out[np.repeat(odd, width)] = self.byte[spelt]
        before = np.concatenate([[0], np.cumsum(width)])
        return out, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])

    def spelt(self, ids: np.ndarray) -> bytes:
        """The text of ids, with its leading space."""
        byte = self.of_byte[ids] >= 0
        if not byte.any():
            return b"".join([self.surface[i] for i in ids.tolist()])
        edges = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        out = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True):
            part = b"".join([self.surface[i] for i in ids[a:b].tolist()])
            out.append(part.decode("utf-8", "each_byte").encode() if byte[a] else part)
        return b"".join(out)

    def decoded(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside of the vocabulary")
        # The leading space of the first piece alone; control ids before it don't matter.
        seen = [i for i in ids.tolist() if self.surface[i]]
        text = self.spelt(ids)
        return (text[1:] if seen and self.leads[seen[0]] else text).decode()


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with a space before each text that is not empty; starts and ends of its words; words of each text."""
    full = offsets[1:] > offsets[:-1]
    raw = np.insert(raw, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    new = raw == 0x20
    new[1:] &= raw[:-1] != 0x20
    # The mark itself, spelt in a text, is a space to the model.
    mark = np.flatnonzero(new[3:] & (raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81)) if len(raw) > 3 else np.zeros(0, np.int64)
    new[mark + 3] = False
    new[offsets[:-1][full]] = True
    start = np.flatnonzero(new)
    return raw, start, np.append(start[1:], len(raw)), np.diff(np.searchsorted(start, offsets))


def encode_words(raw: np.ndarray, offsets: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct words of texts and how many each has; each word's index into them; words of each text."""
    raw, start, end, per = cut(raw, offsets)
    first, inverse = distinct(raw, start, end)
    sizes = (end - start)[first]
    ids, counts = model.ids(raw[spread(start[first], sizes)], sizes)
    return ids, counts, inverse, per


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>), text as it came and rest."""
    docs = framed(docs, text, doc_id)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    source = docs.withColumn("valid", F.make_valid_utf8("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            raw, offsets = text_buffers(batch["valid"])
            for i, j in slices(offsets, 1 << 23):
                ids, counts, inverse, per = encode_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model)
                begin = np.cumsum(counts) - counts
                flat = ids[spread(begin[inverse], counts[inverse])].astype(np.int32)
                total = np.concatenate([[0], np.cumsum(counts[inverse])])[np.concatenate([[0], np.cumsum(per)])]
                part = batch.slice(i, j - i)
                out = {"doc_id": loose(part["doc_id"]), "ids": pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat)), "text": part["text"], "rest": loose(part["rest"])}
                yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, f"doc_id {kind['doc_id']}, ids array<int>, text string, rest {kind['rest']}")


def decode(df: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, decoded (the text of the row's ids) and rest."""
    df = framed(df, ids, doc_id).withColumnRenamed("text", "ids").withColumn("ids", F.col("ids").cast("array<int>"))
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            rows = batch["ids"]
            texts = [model.decoded(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64)) if x.is_valid else None for x in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": loose(batch["doc_id"]), "decoded": pa.array(texts, pa.string()), "rest": loose(batch["rest"])})

    return df.mapInArrow(run, f"doc_id {kind['doc_id']}, decoded string, rest {kind['rest']}")


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without the arrays of ids leaving the task.

    Each distinct word's ids are written and decoded once: a word begins with a space, which no byte piece
    stands for, so no run of byte pieces reaches from one word into the next.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.make_valid_utf8(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        number = [b",%d" % i for i in range(model.size)]
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            n, ids_sha, decoded_sha = [], [], []
            for i, j in slices(offsets, 1 << 23):
                ids, counts, inverse, per = encode_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model)
                ends, own = np.cumsum(counts).tolist(), ids.tolist()
                edges = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
                shown = [b"".join([number[x] for x in own[a:b]]) for a, b in edges]
                spelt = [model.spelt(ids[a:b]) for a, b in edges]
                last = np.concatenate([[0], np.cumsum(per)])
                sums = np.concatenate([[0], np.cumsum(counts[inverse])])
                n += np.diff(sums[last]).tolist()
                for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True):
                    at = inverse[a:b].tolist()
                    ids_sha.append(hashlib.sha256(b"".join([shown[w] for w in at])[1:]).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([spelt[w] for w in at])[1:]).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": loose(batch["doc_id"]), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or model_path())
