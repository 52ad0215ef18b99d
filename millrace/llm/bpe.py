"""BPE encoding and decoding by tree concatenation.

A long text is halved until its leaves are short. The leaves of a batch are encoded together, then
joined pair by pair up the tree: a window around each join is encoded again, and grows until it
agrees with the left side's tokens before the join and with the right side's behind it; only what
lies between the agreed tokens is replaced. A BPE result is exact if each pair of neighbouring
tokens is what encoding makes of that pair, and every pair in the joined list has stood so in one
of the three encodings. A window that has grown to the whole text is simply its encoding.

Places are counted in bytes of the normalised text without white space, from the join: the sum of
the tokens' own lengths. Leaves are looked up piece by piece in a memo of bounded size; pieces end
where every encoding has a boundary, at white space (which is only dropped) and between letters and
punctuation. Ids travel as the bytes of 32-bit numbers.

Normalisation must not reach across a cut. A text in normal form C can be cut anywhere; one that
isn't is brought into it first, each stretch between special tokens by itself, as the library does.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels, store

DEFAULT_FILE = "word_bpe_49k.json"
#: Code points in a leaf and on each side of a join in its first window; bytes of each half of the
#: memo, and of an entry beside its text and ids; neighbouring tokens that must agree on each side.
LEAF = 4096
WINDOW = 24
MEMO_BYTES = 8 << 20
ENTRY_BYTES = 200
#: Bytes of text, and pieces that aren't in the memo, that are encoded at a time.
SLICE = 1 << 18
AT_ONCE = 4096
AGREE = 2
END = "</w>"
_GAP = re.compile("[ \t\n\r]+")
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_PIECE = re.compile(rf"[{_LETTERS}]++(?=[{_MARKS} \t\n\r]|\Z)|[{_MARKS}]++(?=[{_LETTERS} \t\n\r]|\Z)|[^ \t\n\r]+")


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """A tokenizer file with unused truncation and padding. It must be a byte-level BPE that drops
    white space, carries no state across it and has no decoder; its special tokens are ASCII, so
    normalisation makes none."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.leaf = leaf
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(special)})") if special else None
        self.words = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.lengths = [len(w.removesuffix(END)) for w in self.words]

    def forget(self) -> None:
        """Empties the memo, which a task fills for itself."""
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def leaves(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, encoded piece by piece."""
        parts = [self._pieces(t) for t in texts]
        if self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, {}, 0
        memo, old = self.memo, self.old
        new, came = [], []
        for w in set().union(*parts):
            if w not in memo:
                if w in old:
                    memo[w] = old[w]
                    came.append(w)
                else:
                    new.append(w)
        for k in range(0, len(new), AT_ONCE):
            some = new[k : k + AT_ONCE]
            memo.update(zip(some, (_packed(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        self.held += sum(ENTRY_BYTES + 2 * len(w) + len(memo[w]) for w in (*new, *came))
        find = memo.__getitem__
        return [b"".join(map(find, p)) for p in parts]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """Special tokens stand in the text as it is, so nothing is split or lowered where one may
        begin; outside Latin-1, lower case is left to the tokenizer."""
        if "<|" in text:
            return _GAP.split(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECE.findall(text)
        return _PIECE.findall(text.lower())

    def _stretches(self, text: str) -> list[str]:
        """Stretches of a text that are encoded one after the other, each in normal form C."""
        if len(text) <= self.leaf or unicodedata.is_normalized("NFC", text):
            return [text]
        parts = self.special.split(text) if self.special else [text]
        return [p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(parts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as if it were encoded whole."""
        stretches = [self._stretches(t) for t in texts]
        parts = [p for s in stretches for p in s]
        cuts = [halves(len(p), self.leaf) for p in parts]
        pieces = self.leaves([p[a:b] for p, c in zip(parts, cuts, strict=True) for a, b in c])
        out, at = [], 0
        for part, c in zip(parts, cuts, strict=True):
            own = [(a, b, ids) for (a, b), ids in zip(c, pieces[at : at + len(c)], strict=True)]
            at += len(c)
            while len(own) > 1:
                own = [self.join(part, own[k], own[k + 1]) for k in range(0, len(own), 2)]
            out.append(own[0][2])
        ends = np.cumsum([0, *map(len, stretches)]).tolist()
        return [b"".join(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def join(self, text: str, left: tuple[int, int, bytes], right: tuple[int, int, bytes]) -> tuple[int, int, bytes]:
        """Two neighbouring stretches of ``text`` (start, end, ids) as one."""
        (a, mid, head), (_, b, tail) = left, right
        size, lengths = WINDOW, self.lengths
        while True:
            low, high = max(a, mid - size), min(b, mid + size)
            ids, before = map(unpacked, self.leaves([text[low:high], text[low:mid]]))
            start = -sum(lengths[i] for i in before)
            end = start + sum(lengths[i] for i in ids)
            p = (0, len(head) // 4) if low == a else self._agreed(ids, start, unpacked(head[start * 4 :]))
            q = (0, len(tail) // 4) if high == b else self._agreed(ids[::-1], -end, unpacked(tail[: end * 4])[::-1])
            if p and q and p[0] + q[0] <= len(ids):
                return a, b, head[: len(head) - 4 * p[1]] + _packed(ids[p[0] : len(ids) - q[0]]) + tail[4 * q[1] :]
            size *= 2

    def _agreed(self, ids: list[int], start: int, side: list[int]) -> tuple[int, int] | None:
        """For tokens in order towards the join, those of the window from place ``start`` and the
        last of ``side`` up to place 0: how many of the window's there are up to the last that
        ``side`` has at the same place too, as it has the ``AGREE - 1`` before; and how many of
        ``side``'s come behind it. None if there is no such token."""
        own, at = {}, 0
        for behind, i in enumerate(reversed(side)):
            own[-at, i] = behind
            at += self.lengths[i]
            if at > -start:
                break
        best, run, place = None, 0, start
        for k, i in enumerate(ids):
            place += self.lengths[i]
            behind = own.get((place, i))
            run = 0 if behind is None else run + 1
            if run >= AGREE:
                best = (k + 1, behind)
        return best

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a file without a decoder: the
        tokens joined by one space."""
        return " ".join(map(self.words.__getitem__, unpacked(ids)))


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return memoryview(ids).cast("i").tolist()


@cache
def codec(path: str) -> Codec:
    """The process's codec of a file: one, as what a tokenizer leaves behind isn't all given back."""
    return Codec(path)


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves of a text of ``n`` code points, a power of two of them."""
    parts = 1
    while n > parts * leaf:
        parts *= 2
    edges = [n * k // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def encode_documents(df: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ids array<int> and decoded string of each whole text.

    Null or empty text: no ids and an empty string. A text of any length is encoded in leaves.
    Repeated rows get a result each, an empty table gives an empty one, and other columns are
    dropped, so none can clash. ``path``: a tokenizer file that every executor has.
    """
    path = path or tokenizer_path()
    schema = store.widened(df, keep, "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            yield from coded(own, batches)
        finally:
            own.forget()

    def coded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "_text", SLICE):
                ids = own.encode([t or "" for t in part.column("_text").to_pylist()])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(map(own.decode, ids), pa.string())], schema.names)

    return kernels.in_tasks(df.select(*keep, F.col(text).alias("_text")), run, schema)
