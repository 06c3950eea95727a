"""Byte-level BPE encoding and decoding as bounded-lookahead streaming transducers."""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed values end.

#: Characters of context that decide where a piece ends: the longest contraction.
TAIL = 3
#: A text is read in parts of so many characters.
PART = 1 << 16
#: A piece with more characters goes through the transducer; shorter ones are looked up or merged at once.
LONG = 1 << 10
#: Pieces that a worker remembers; the memory is emptied when full.
MEMORY = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The published map from printable stand-ins to bytes: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A merge list with what the transducers need: pair -> (rank, id), bytes of each id, and the sufficient lookahead.

    lookahead: whether the encoding has a token boundary at a byte position depends on no more than so many bytes to the
    right of it. A merge (x, y) of rank r at a place fails only if y is taken first by a merge (y, z) of lower rank, or if
    y itself can't be formed; both depend only on merges of lower ranks further right. With reach[r] the bytes beyond the
    merge's own end that may decide it,
        reach[r] = max(reach of x less len(y), reach of y, max over (y, z) of rank below r of len(z) + their reach),
    taken in order of rank, and the lookahead is the largest len(z) + reach over all merges.
    """

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)
        vocab, alphabet = model["model"]["vocab"], byte_alphabet()
        self.bytes_of = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocab.items()}
        self.first = [0] * 256
        for i, t in self.bytes_of.items():
            if len(t) == 1:
                self.first[t[0]] = i
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        reach_of: dict[int, int] = {}
        beyond: dict[int, int] = {}
        self.lookahead = 0
        for rank, pair in enumerate(model["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[x], vocab[y], vocab[x + y]
            self.pairs.setdefault((x, y), (rank, made))
            n = len(self.bytes_of[y])
            reach = max(reach_of.get(x, 0) - n, reach_of.get(y, 0), beyond.get(y, 0), 0)
            reach_of[made] = max(reach_of.get(made, 0), reach)
            beyond[x] = max(beyond.get(x, 0), n + reach)
            self.lookahead = max(self.lookahead, n + reach)

    def encode_whole(self, data: bytes) -> list[int]:
        """Tokens of one piece: the lowest-ranked pair merges first, leftmost among equals."""
        ids = [self.first[b] for b in data]
        if len(ids) > 48:
            return self._encode_heap(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best, at = (1 << 60, -1), -1
            for k, pair in enumerate(zip(ids, ids[1:])):
                found = pairs.get(pair)
                if found is not None and found[0] < best[0]:
                    best, at = found, k
            if at < 0:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _encode_heap(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], k, ids[k], ids[k + 1], f[1]) for k in range(n - 1) if (f := pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != x or j < 0 or ids[j] != y:
                continue
            ids[k], ids[j], after[k] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if f := pairs.get((made, ids[after[k]])):
                    heapq.heappush(heap, (f[0], k, made, ids[after[k]], f[1]))
            if (i := before[k]) >= 0 and (f := pairs.get((ids[i], made))):
                heapq.heappush(heap, (f[0], i, ids[i], made, f[1]))
        return [x for x in ids if x >= 0]


class PieceTransducer:
    """Encodes one piece that arrives in parts. A token leaves as soon as its end is `lookahead` bytes behind the input.

    Tokens that have left are a prefix of the whole encoding, and what follows a token boundary is encoded on its own,
    so the state is the bytes after the last stable boundary: at most the lookahead, the longest token and one part.
    """

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        if len(self.held) <= 4 * self.merges.lookahead + LONG:
            return []
        out, end = [], 0
        for t in self.merges.encode_whole(self.held):
            if end + len(self.merges.bytes_of[t]) > len(self.held) - self.merges.lookahead:
                break
            out.append(t)
            end += len(self.merges.bytes_of[t])
        self.held = self.held[end:]
        return out

    def flush(self) -> list[int]:
        out, self.held = self.merges.encode_whole(self.held), b""
        return out


class Encoder:
    """Streaming encoder: feed() takes the next part of a text and returns tokens that no later part can change; flush() ends it.

    Memory is constant: the remembered pieces (at most MEMORY), the open piece's transducer and one part of text.
    Strings of special tokens in the text become their ids, as in the published encoder.
    """

    #: How an open piece goes on, by the kind of its last character.
    ON = {k: regex.compile(p) for k, p in {"L": r"\p{L}+", "N": r"\p{N}+", "S": r"\s+", "O": r"[^\s\p{L}\p{N}]+"}.items()}

    def __init__(self, merges: Merges):
        self.merges, self.split = merges, regex.compile(PATTERN)
        self.memory: dict[str, tuple[int, ...]] = {}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.mark_tail = max(map(len, merges.special), default=1) - 1
        self.raw, self.text, self.open, self.kind = "", "", None, ""

    def _piece(self, piece: str) -> tuple[int, ...]:
        """A whole piece, through a transducer in parts; short ones are remembered."""
        data = piece.encode("utf-8", "surrogatepass")
        way = PieceTransducer(self.merges)
        out = [t for k in range(0, len(data), LONG) for t in way.feed(data[k : k + LONG])]
        found = tuple(out + way.flush())
        if len(piece) <= LONG:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = found
        return found

    def _plain(self, part: str, last: bool) -> list[int]:
        """Text without special strings; last: nothing follows that these characters could join."""
        out: list[int] = []
        self.text += part
        if self.open is not None:
            self._go_on(out, last)
            if self.open is not None:
                return out
        pieces, end = self.split.findall(self.text), len(self.text)  # the pieces side by side are the text
        if not last:
            ends = list(itertools.accumulate(map(len, pieces)))
            n = bisect.bisect_right(ends, len(self.text) - TAIL)
            pieces, end = pieces[:n], ends[n - 1] if n else 0
        found = list(map(self.memory.get, pieces))
        if None in found:
            found = [f or self._piece(m) for f, m in zip(found, pieces)]
        out += itertools.chain.from_iterable(found)
        self.text = self.text[end:]
        if len(self.text) > LONG + 2 * TAIL:  # a piece longer than this is open: hand on all but its last characters
            self.open = PieceTransducer(self.merges)
            c = self.text[1]
            self.kind = next(k for k, p in self.ON.items() if p.match(c))
            self._go_on(out, last)
        return out

    def _go_on(self, out: list[int], last: bool) -> None:
        whole = self.text
        m = self.ON[self.kind].match(whole, 1 if whole[:1] == " " and self.kind != "S" and not self.open.held else 0)
        end = m.end() if m else 0
        ended = last or end < len(whole)
        if self.kind == "S" and not (last and end == len(whole)):
            end = max(end - 1, 0)  # the last blank of a run stays out if something follows
        elif not ended:
            end = max(end - 1, 0)
        out += self.open.feed(whole[:end].encode("utf-8", "surrogatepass"))
        self.text = whole[end:]
        if ended:
            out += self.open.flush()
            self.open = None

    def feed(self, part: str) -> list[int]:
        if self.marks is None:
            return self._plain(part, False)
        self.raw += part
        out, start = [], 0
        for m in self.marks.finditer(self.raw):
            out += self._plain(self.raw[start : m.start()], True)
            out.append(self.merges.special[m.group()])
            start = m.end()
        keep = max(start, len(self.raw) - self.mark_tail)
        out += self._plain(self.raw[start:keep], False) if keep > start else []
        self.raw = self.raw[keep:]
        return out

    def flush(self) -> list[int]:
        raw, self.raw = self.raw, ""
        return self._plain(raw, True)

    def encode(self, text: str) -> list[int]:
        """All tokens of a text, read in parts."""
        return [t for k in range(0, len(text), PART) for t in self.feed(text[k : k + PART])] + self.flush()


class Decoder:
    """Streaming decoder: a byte-to-text state machine whose state is the bytes of one unfinished character.

    Bytes that form no character give U+FFFD, one for each longest beginning of a character. Unknown ids are left out.
    """

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        none = b""
        return self.state.decode(b"".join([self.bytes_of.get(t, none) for t in ids]))

    def flush(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.feed(ids[k : k + PART]) for k in range(0, len(ids), PART)) + self.flush()


_MADE: dict[str, tuple[Merges, Encoder]] = {}


def _tools(tokenizer_json: str) -> tuple[Merges, Encoder]:
    """The merge list and a memory of pieces, kept by each Python worker for as long as it lives."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        merges = Merges(tokenizer_json)
        _MADE[key] = merges, Encoder(merges)
    return _MADE[key]


def load(path: str) -> str:
    """The tokenizer file's text. It is read on the driver and sent to the executors (a vocabulary file: a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with an array column of token ids. A null text gives no tokens, as an empty one; `out` replaces a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tool = _tools(sent.value)[1]
        return pd.Series([tool.encode(t or "") for t in texts])

    return docs.withColumn(out, run(F.col(text)))


def decode(docs: DataFrame, tokenizer_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text that an array of token ids stands for. A null array gives an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        merges = _tools(sent.value)[0]
        return pd.Series([Decoder(merges).decode([] if t is None else list(t)) for t in lists])

    return docs.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and the ids decoded again, in one pass.

    Null and empty texts have no tokens and the hash of the empty string. Rows may repeat; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        merges, tool = _tools(sent.value)
        decoder, name, digest = Decoder(merges), {i: str(i) for i in merges.bytes_of}.__getitem__, hashlib.sha256
        for texts in parts:
            rows = []
            for t in texts:
                ids = tool.encode(t or "")
                said = digest(",".join(map(name, ids)).encode()).hexdigest()
                rows.append((len(ids), said, digest(decoder.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, run(F.col(text)).alias("__d")).select(key, "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")
