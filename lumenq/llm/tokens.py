"""Edit-aware token counts over segment trees of pre-tokens.

A text is cut into pre-tokens by the tokenizer's pattern; byte-pair merges
never cross them, so the count of a text is the sum over its pre-tokens. A
document's tree has blocks of pre-tokens as leaves and sums of characters and
tokens above. An edit finds the first pre-token that may change (one within
CONTEXT characters before the edit), cuts again from there until a cut falls
on an old one beyond the edit, encodes only these pre-tokens, and updates the
sums on the way to the root. The pattern looks ahead but never back, so from a
common cut on both texts are cut alike.

Rows are independent: no shuffle; null and repeated ids and rows are no matter.
Null texts have no tokens; edits on them apply to the empty text. Edit
positions are code points of the text before it, clamped to its length; edits
are applied in the order given, null ones are left out. An empty table gives no
rows; a long text takes memory in proportion to itself.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of the machine; the folder can be set, the file is a parameter of ``count``.
VOCABULARY = os.path.join(os.environ.get("LUMENQ_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXT, BLOCK, CACHED = 4, 64, 300_000
_MADE: dict[int, Encoder] = {}


class Encoder:
    """Pre-tokens and their token counts; counts of recent pre-tokens are kept."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.pattern = regex.compile(PATTERN)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            # a pre-token cut out by itself may be cut again ("\\s+(?!\\S)" looks ahead), which changes no merge
            n = self.known[piece] = len(self.encode(piece))
        return n

    @staticmethod
    def of(ranks: bytes) -> Encoder:
        key = hash(ranks)
        if key not in _MADE:
            _MADE[key] = Encoder(ranks)
        return _MADE[key]


class Tree:
    """Sums of characters and tokens over blocks of pre-tokens."""

    def __init__(self, text: str, encoder: Encoder):
        self.text, self.encoder, self.encoded = text, encoder, 0
        pieces = encoder.pattern.findall(text)
        known, count = encoder.known, encoder.count
        tokens = np.fromiter((known.get(p) or count(p) for p in pieces), np.int64, len(pieces))
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.n_pieces = len(pieces)
        cuts = np.arange(0, len(pieces), BLOCK)
        self.blocks = [(chars[a : a + BLOCK], tokens[a : a + BLOCK]) for a in cuts]
        size = 1
        while size < max(1, len(cuts)):
            size *= 2
        self.size = size
        self.sums = np.zeros((2, 2 * size), np.int64)
        if len(cuts):
            self.sums[0, size : size + len(cuts)] = np.add.reduceat(chars, cuts)
            self.sums[1, size : size + len(cuts)] = np.add.reduceat(tokens, cuts)
        while size > 1:
            self.sums[:, size // 2 : size] = self.sums[:, size : 2 * size : 2] + self.sums[:, size + 1 : 2 * size : 2]
            size //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, place: int) -> tuple[int, int]:
        """The block that holds this character, and the characters before the block."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.sums[0, node] and self.sums[0, node + 1]:
                before += int(self.sums[0, node])
                node += 1
        return node - self.size, before

    def _set(self, block: int) -> None:
        node = block + self.size
        self.sums[0, node], self.sums[1, node] = self.blocks[block][0].sum(), self.blocks[block][1].sum()
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + replacement + self.text[end:]
        shift, past = len(text) - n, start + len(replacement)
        if not n:
            encoded = self.encoded
            self.__init__(text, self.encoder)
            self.encoded = encoded + self.n_pieces
            return
        block, at = self._find(max(0, start - CONTEXT))
        ends = at + np.cumsum(self.blocks[block][0])
        first = int(np.searchsorted(ends, start - CONTEXT, "left"))  # ends before that cannot change
        if first == len(ends):
            first -= 1
        begin = int(ends[first - 1]) if first else at
        # old cuts beyond the edit, block by block
        last, edge = block, int(ends[-1])
        old, k = ends, 0
        new: list[str] = []
        place, met = begin, False
        for match in self.encoder.pattern.finditer(text, begin):
            new.append(match.group())
            place = match.end()
            if place < past:
                continue
            while True:
                while k < len(old) and old[k] < place - shift:
                    k += 1
                if k < len(old) or last + 1 >= len(self.blocks):
                    break
                last += 1
                old = edge + np.cumsum(self.blocks[last][0])
                edge, k = int(old[-1]) if len(old) else edge, 0
            if k < len(old) and old[k] == place - shift and old[k] >= end:
                met = True
                break
        counts = np.array([self.encoder.count(p) for p in new], np.int64)
        lengths = np.array([len(p) for p in new], np.int64)
        self.encoded += len(new)
        if met:
            stop = k + 1
        else:  # the edit reaches the end of the text
            last, stop = len(self.blocks) - 1, len(self.blocks[-1][0])
        parts = [(self.blocks[block][i][:first], x, self.blocks[last][i][stop:]) for i, x in ((0, lengths), (1, counts))]
        gone = sum(len(self.blocks[b][0]) for b in range(block, last + 1))
        self.blocks[block] = (np.concatenate(parts[0]), np.concatenate(parts[1]))
        self.n_pieces += len(self.blocks[block][0]) - gone
        empty = np.zeros(0, np.int64)
        for b in range(block + 1, last + 1):
            self.blocks[b] = (empty, empty)
            self._set(b)
        self._set(block)
        self.text = text


def count(docs: DataFrame, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of each row, and after ``edits`` (an
    array of structs start, end, replacement) ``edited_pretokens,
    edited_tokens, reencoded``, the pre-tokens that were encoded again."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: give its path, or set LUMENQ_TOKENIZERS to its folder")
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: fixed size
    kind = "array<struct<start:int,end:int,replacement:string>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.array() if edits is None else edits).cast(kind).alias("edits"))
    names = ["doc_id", "n_pretokens", "n_tokens", "edited_pretokens", "edited_tokens", "reencoded"]

    def run(batches):
        encoder = Encoder.of(shipped.value)
        for batch in batches:
            out = []
            for text, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = Tree(text.as_py() or "", encoder)
                before = (tree.n_pieces, tree.n_tokens)
                for e in changes.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                out.append((*before, tree.n_pieces, tree.n_tokens, tree.encoded))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
