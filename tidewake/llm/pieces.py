"""SentencePiece encoding and decoding by max-plus products: the same ids as the library's for a BPE model file.

A sequence of pieces is what byte-pair merging makes of a text if and only if each two neighbours are what merging makes
of their own text, and each text has exactly one such sequence. So encoding is a path problem: a state is a piece and
where it ends, a step to the next piece weighs 0 if the two fit and minus infinity if they don't, and the best path to
the end of the text is the encoding. A chunk's transfer matrix over (max, +) says from which states at its start which
states at its end are reached with weight 0; all else is minus infinity, so a matrix is kept as the list of its zeros.
Matrices combine associatively: a giant text's chunks are worked on apart; the matrices of FAN chunks in a row are multiplied in
one task, and so are those of FAN products, until one task holds what is left; on the way back each product's first states
give those of its FAN parts. So no task ever holds more than FAN matrices of a text, however long it is. Each chunk then
finds its own part of the path and backtraces alone.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a text's own U+2581 within this module; a lone surrogate, so no text has it.
OWN = "\udc00"
#: The piece of a character that no piece has (its bytes take its place), and what stands before a text.
UNKNOWN, START = -1, -2
#: The state behind a text's end.
END = (0, -3)
#: Pairs of pieces whose fit a worker remembers.
PAIRS = 2_000_000
#: Texts with more code points than GIANT are encoded by chunks of CHUNK on all executors.
GIANT, CHUNK = 1 << 16, 1 << 14
#: Matrices that one task multiplies.
FAN = 32
#: Words whose pieces a Python worker remembers, and as many again that it is about to forget.
REMEMBERED = 150_000


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, model: str | bytes = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        self.size = p.get_piece_size()
        self.bytes_at = 0
        self.scores: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        for i in range(self.size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at = i - value
                self.raw.append(bytes([value]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.raw.append(b"")
            else:
                self.scores[piece] = round(p.get_score(i))
                self.ids[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in x.lstrip(SPACE) for x in self.scores):
            raise ValueError("the words of this model's pieces aren't apart")  # words are encoded one by one
        self.longest = max(map(len, self.scores))
        # The pieces' trie: character to (score, id, children); score and id are null where only a longer piece goes on.
        self.names = {i: piece for piece, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.trie: dict = {}
        for piece, i in sorted(self.ids.items()):
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, (None, None, {}))[2]
            node[piece[-1]] = (self.scores[piece], i, node.get(piece[-1], (None, None, {}))[2])

    def merged(self, text: str) -> list[str]:
        """What byte-pair merging makes of a text: again and again the best-scored piece of two neighbours, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            found = [(-s, k) for k in range(len(parts) - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are behind one another."""
        if a < 0 or b < 0:
            return True
        key = a * self.size + b
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.names[a], self.names[b]
            ok = x + y not in self.scores and self.merged(x + y) == [x, y]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def walk(self, text: str, n: int, at: int = 0, piece: int = START) -> tuple[list, list]:
        """From a state (piece ends at at): the pieces that end at each position, and where they start, by steps of weight 0
        that start before n. Null where the state leads nowhere; -1 is the start of what was given."""
        end = len(text)
        last: list = [None] * (end + 1)
        back = [-1] * (end + 1)
        last[at] = piece
        trie, size, pairs = self.trie, self.size, self.pairs
        for i in range(at, n):
            before = last[i]
            if before is None:
                continue
            node, base, one = trie, before * size, False
            for j in range(i, end):
                found = node.get(text[j])
                if found is None:
                    break
                _, b, node = found
                if b is not None:
                    one |= j == i
                    if last[j + 1] is None:
                        ok = True if before < 0 else pairs.get(base + b)
                        if ok or ok is None and self.fits(before, b):
                            last[j + 1] = b
                            back[j + 1] = i
            if not one and last[i + 1] is None:
                last[i + 1] = UNKNOWN
                back[i + 1] = i
        return last, back

    def spell(self, text: str, last: list, back: list, at: int) -> list[int]:
        """Ids of the path that ends at at, back to what was given."""
        out: list[int] = []
        while back[at] >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes_at + b for b in reversed(text[back[at] : at].replace(OWN, SPACE).encode())]
            at = back[at]
        out.reverse()
        return out

    def word(self, text: str) -> list[int]:
        """Ids of a normalised text without looking beyond it."""
        n = len(text)
        return self.spell(text, *self.walk(text, n), n)

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(characters behind at, piece) of all pieces that end at or behind at and start before it."""
        out = []
        for i in range(max(0, at - self.longest), at):
            node = self.trie
            for j in range(i, len(text)):
                found = node.get(text[j])
                if found is None:
                    break
                node = found[2]
                if found[1] is not None and j + 1 >= at:
                    out.append((j + 1 - at, found[1]))
        known = self.trie.get(text[at - 1], (None, None))[1] is not None
        return out if known else [*out, (0, UNKNOWN)]

    def transfer(self, text: str, n: int, behind: int) -> list[list]:
        """The chunk's matrix as its zeros: [state before, states after] with a state as [offset, piece].

        text has behind characters in front of the chunk's n and those that a piece can reach after it. All ways
        that come to a word's start fit whatever follows, so what lies beyond it is worked out once.
        """
        stop = behind + n
        first = self.states(text, behind) if behind else [(0, START)]
        meet = next((i for i in range(behind + self.longest, stop) if text[i] == SPACE and text[i - 1] != SPACE), None)
        rest = self._ends(self.walk(text, stop, meet, START)[0], stop) if meet is not None else []
        out = []
        for a, piece in first:
            last = self.walk(text[:meet] if meet is not None else text, meet if meet is not None else stop, behind + a, piece)[0]
            ends = (rest if last[meet] is not None else []) if meet is not None else self._ends(last, stop)
            if ends:
                out.append([[a, piece], ends])
        return out

    def _ends(self, last: list, stop: int) -> list:
        return [[j - stop, last[j]] for j in range(stop, min(stop + self.longest, len(last))) if last[j] is not None]

    def decode(self, ids) -> str:
        """The text of ids; of bytes that aren't UTF-8, the replacement character."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


class Memory(dict):
    """Word (after its space) to its pieces' ids as int32 bytes. When it is full, only words met since it last was are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = array("i", self.vocabulary.word(SPACE + word if not word.startswith(" ") else word.replace(" ", SPACE))).tobytes()
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@functools.cache
def memory_of(model: str | bytes) -> Memory:
    """One memory a process: Python workers keep it from task to task."""
    return Memory(Vocabulary(model))


_GAPS = re.compile(" {2,}[^ ]*| [^ ]+| $")


def normalised(text: str) -> str:
    """The text as pieces see it, character by character: spaces are SPACE, and a SPACE of its own is OWN, which no piece has."""
    return text.replace(SPACE, OWN).replace(" ", SPACE)


def encode(text: str, memory: Memory) -> np.ndarray:
    """Ids of a text; none for an empty one. Pieces never span the start of a word, so words are encoded apart."""
    if not text:
        return np.empty(0, np.int32)
    text = text.replace(SPACE, OWN)
    if "  " in text or text[0] == " ":
        words = [w if w.startswith("  ") or w == " " else w[1:] for w in _GAPS.findall(" " + text)]
        words = ["" if w == " " else w for w in words]
    else:
        words = text.split(" ")
    return np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32)


def _one_task(model):
    """Encodes Arrow batches of (doc_id, text): doc_id, ids, n_tokens, round_trip."""

    def run(batches):
        memory = memory_of(model)
        v = memory.vocabulary
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 200):
                some = texts[a : a + 200]
                ids = [encode(t or "", memory) for t in some]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                same = [v.decode(x.tolist()) == (t or "") for x, t in zip(ids, some)]
                flat = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(some)).cast(pa.int64()), lists, pa.array(n), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return run


def _split(size: int):
    """Giant texts to chunks: (row, doc_id, chunk, last, behind, n, text): n characters with those that a piece can reach on either side."""

    def run(batches):
        for pdf in batches:
            for row, doc_id, reach, text in zip(pdf["row"], pdf["doc_id"], pdf["reach"], pdf["text"]):
                s = " " + text
                for c, at in enumerate(range(0, len(s), size)):
                    start = max(0, at - reach)
                    yield pd.DataFrame({"row": [row], "doc_id": pd.array([doc_id], "Int64"), "chunk": [c], "last": [at + size >= len(s)], "behind": [at - start], "n": [min(size, len(s) - at)], "text": [s[start : at + size + reach]]})

    return run


def _by_chunk(model, work, columns):
    def run(batches):
        v = memory_of(model).vocabulary
        for pdf in batches:
            yield pd.DataFrame([work(v, r, normalised(r.text)) for r in pdf.itertuples(index=False)], columns=columns)

    return run


def _transfer(v, r, text):
    return r.row, r.chunk, json.dumps(v.transfer(text, r.n, r.behind))


def _matrix(text: str) -> dict:
    return {tuple(a): [tuple(b) for b in ends] for a, ends in json.loads(text)}


def product(matrices: list[dict]) -> dict:
    """The max-plus product of matrices in a row, each the list of its zeros: state before to the states after."""
    out = matrices[0]
    for m in matrices[1:]:
        out = {a: reached for a, ends in out.items() if (reached := sorted({c for b in ends for c in m.get(b, ())}))}
    return out


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """The product of the matrices of one block."""
    pdf = pdf.sort_values("at")
    m = product([_matrix(x) for x in pdf["matrix"]])
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "at": pdf["block"].iloc[:1], "matrix": [json.dumps([[a, ends] for a, ends in m.items()])]})


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states that are reached where each part of a block begins, from those where the block begins."""
    pdf = pdf.sort_values("at")
    out, now = [], {tuple(x) for x in json.loads(pdf["come"].iloc[0])}
    for m in pdf["matrix"]:
        out.append(json.dumps(sorted(now)))
        m = _matrix(m)
        now = {b for a in now for b in m.get(a, ())}
    return pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "come": out})


def prefix_states(matrices: DataFrame, first: str) -> DataFrame:
    """(row, at, come): for each of a row's matrices (row, at from 0, matrix) the states that those before it reach from first."""
    blocks = matrices.withColumn("block", F.expr(f"at div {FAN}"))
    if (blocks.agg(F.max("at")).first()[0] or 0) < FAN:
        come = blocks.withColumn("come", F.lit(first))
    else:
        products = keep(blocks.groupBy("row", "block").applyInPandas(_products, "row long, at long, matrix string"))
        come = blocks.join(prefix_states(products, first).withColumnRenamed("at", "block"), ["row", "block"])
    return keep(come.groupBy("row", "block").applyInPandas(_spread, "row long, at long, come string"))


def _ways(v, r, text):
    """The chunk's walks from each state that it can begin with."""
    for a, piece in json.loads(r.entry):
        yield [a, piece], *v.walk(text, r.behind + r.n, r.behind + a, piece)


def _exits(v, r, text):
    """The state that the chunk begins with, by the one it ends with: a matrix that is read from the text's end to its beginning.

    The last chunk's takes END to where the path of the text ends.
    """
    stop, found = r.behind + r.n, []
    for a, last, _ in _ways(v, r, text):
        if r.last and last[stop] is not None:
            found.append([END, [a]])
        elif not r.last:
            found += [[e, [a]] for e in v._ends(last, stop)]
    return r.row, r.chunk, json.dumps(found)


def _trace(v, r, text):
    """The ids of a chunk's part of the path, which ends where the states behind it (leave) begin."""
    stop, leave = r.behind + r.n, tuple(json.loads(r.leave)[0])
    for a, last, back in _ways(v, r, text):
        b = 0 if leave == END else leave[0]
        if stop + b < len(last) and last[stop + b] is not None and (leave == END or last[stop + b] == leave[1]):
            return r.row, r.doc_id, r.chunk, v.spell(text, last, back, stop + b)
    raise ValueError("no way through a chunk")


def _joined(model):
    def run(batches):
        v = memory_of(model).vocabulary
        for pdf in batches:
            ids = [[i for part in parts for i in part] for parts in pdf["parts"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": ids, "n_tokens": [len(x) for x in ids], "round_trip": [v.decode(x) == t for x, t in zip(ids, pdf["text"])]})

    return run


_RESULT = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"


def encode_giants(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """encode() for texts of any length, by chunks on all executors: a text's chunks never meet in one task but as ids."""
    spark = docs.sparkSession
    v = Vocabulary(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = keep(rows)
    chunks = rows.withColumn("reach", F.lit(v.longest)).mapInPandas(_split(CHUNK), "row long, doc_id long, chunk long, last boolean, behind int, n int, text string")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = keep(chunks.repartition(n, "row", "chunk"))
    at = ["row", "chunk"]
    matrices = keep(chunks.mapInPandas(_by_chunk(model, _transfer, ["row", "at", "matrix"]), "row long, at long, matrix string"))
    entries = prefix_states(matrices, json.dumps([(0, START)])).select("row", F.col("at").alias("chunk"), F.col("come").alias("entry"))
    chunks = chunks.join(entries, at)
    exits = keep(chunks.mapInPandas(_by_chunk(model, _exits, ["row", "chunk", "matrix"]), "row long, chunk long, matrix string"))
    most = exits.groupBy("row").agg(F.max("chunk").alias("most"))
    exits = keep(exits.join(most, "row").select("row", (F.col("most") - F.col("chunk")).alias("at"), "most", "matrix"))
    leaves = prefix_states(exits.select("row", "at", "matrix"), json.dumps([END])).join(most, "row").select("row", (F.col("most") - F.col("at")).alias("chunk"), F.col("come").alias("leave"))
    parts = chunks.join(leaves, at).mapInPandas(_by_chunk(model, _trace, ["row", "doc_id", "chunk", "ids"]), "row long, doc_id long, chunk long, ids array<int>")
    whole = parts.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]).alias("parts"))
    return whole.join(rows, "row").select("doc_id", "text", "parts").mapInPandas(_joined(model), _RESULT)


def encode_documents(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """Per row of docs: doc_id, ids (array<int>), n_tokens, round_trip (decoding the ids gives the text).

    Null and empty texts have no ids. A text's own U+2581 is told by its bytes, so that decoding gives it
    back; characters that no piece has are told by theirs. Texts of more than GIANT code points are split
    into chunks; the result is the same. Null or equal doc_ids and repeated rows don't matter. model is the
    path of a SentencePiece model file, or its bytes, and is never copied.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    giant = F.length("text") > GIANT
    small = docs.where(F.coalesce(~giant, F.lit(True))).mapInArrow(_one_task(model), _RESULT)
    giants = docs.where(giant)
    return small.union(encode_giants(giants, model)) if giants.limit(1).count() else small


def decode_documents(encoded: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids count as none and give an empty text."""

    def run(batches):
        v = memory_of(model).vocabulary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": ["" if x is None else v.decode(x) for x in pdf["ids"]]})

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
