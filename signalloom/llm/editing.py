"""Token counts that follow edits (operator 8).

A document is a segment tree over its pieces (see ``tokenizing``): a node knows how many
characters and tokens stand below it. An edit finds its pieces by descending the tree,
encodes only them and a piece of context on either side, and corrects the sums above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import map_batches, texts
from signalloom.llm.tokenizing import TextEncoder, library_encoder


class TokenTree:
    """The pieces of one text and their sums of characters and tokens.

    The tree keeps its shape. The new text of an edited region stands in the region's first
    leaf, the others become empty; a leaf is cut into pieces again whenever it is encoded.
    Every leaf but the first begins with a space and a non-space that its last edit did not
    touch, so what stands before it never changes its tokens.
    """

    def __init__(self, pieces: list[str], counts: np.ndarray, encoder: TextEncoder):
        self.encoder = encoder
        self.leaves = list(pieces)
        self.size = size = 1 << max(len(pieces) - 1, 0).bit_length()
        self.sums = np.zeros((2 * size, 2), np.int64)
        self.sums[size : size + len(pieces), 0] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.sums[size : size + len(pieces), 1] = counts
        while size > 1:
            self.sums[size // 2 : size] = self.sums[size : 2 * size : 2] + self.sums[size + 1 : 2 * size : 2]
            size //= 2
        self.encoded_again = 0

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character ``at``, where in it); the end belongs to the last leaf with text."""
        node = 1
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            right = int(self.sums[2 * node + 1, 0])
            if at < left or not right:
                node = 2 * node
            else:
                node, at = 2 * node + 1, at - left
        return node - self.size, at

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf with text to the left (-1) or right (1), or the leaf itself."""
        k = leaf + step
        while 0 <= k < len(self.leaves):
            if self.leaves[k]:
                return k
            k += step
        return leaf

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def region(self, start: int, length: int, replacement: str) -> tuple[int, int, str]:
        """(first leaf, last leaf, their text) of what an edit touches, with the edit made in the text.

        Places beyond the text mean its end, negative ones its begin.
        """
        start = min(max(start, 0), self.characters)
        stop = min(max(start + length, start), self.characters)
        first, inside = self._find(start)
        last, _ = self._find(stop)
        low, high = self._beside(first, -1), self._beside(max(last, first), 1)
        before = sum(map(len, self.leaves[low:first])) + inside
        text = "".join(self.leaves[low : high + 1])
        return low, high, text[:before] + replacement + text[before + stop - start :]

    def put(self, low: int, high: int, text: str, tokens: int) -> None:
        """Let a region have another text, whose tokens are known."""
        self.encoded_again += len(text)
        self._set(low, text, tokens)
        for leaf in range(low + 1, high + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Replace ``length`` characters from ``start`` on; gives the tokens afterwards."""
        found = self.region(start, length, replacement)
        ((_, counts),) = self.encoder.counts([found[2]])
        self.put(*found, int(counts.sum()))
        return self.tokens


def edited_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", edits: str = "edits"
) -> DataFrame:
    """Tokens of every whole text before and after its edits.

    ``edits`` is an array of (start, length, text), applied in order, in characters of the
    text as the edits before left it. Gives key, n_tokens, n_edits, edited_tokens,
    edited_chars, encoded_again (characters encoded for the edits). NULL texts are empty;
    a NULL array, or a NULL edit in it, changes nothing; a NULL text of an edit is empty.
    """

    def run(batch):
        encoder = library_encoder(path)
        trees = [TokenTree(p, c, encoder) for p, c in encoder.counts(texts(batch.column(1)))]
        before = [t.tokens for t in trees]
        changes = [[e for e in x or [] if e is not None and e["start"] is not None] for x in batch.column(2).to_pylist()]
        # Edits of one text follow one another; those of different texts are encoded in one call.
        for turn in range(max(map(len, changes), default=0)):
            due = [(t, c[turn]) for t, c in zip(trees, changes) if turn < len(c)]
            found = [t.region(e["start"], e["length"] or 0, e["text"] or "") for t, e in due]
            for (tree, _), region, (_, counts) in zip(due, found, encoder.counts([r[2] for r in found])):
                tree.put(*region, int(counts.sum()))
        rows = [(n, len(c), t.tokens, t.characters, t.encoded_again) for n, c, t in zip(before, changes, trees)]
        names = ["n_tokens", "n_edits", "edited_tokens", "edited_chars", "encoded_again"]
        return {key: batch.column(0)} | {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, n_edits long, edited_tokens long, edited_chars long, encoded_again long"
    return map_batches(docs, [key, text, edits], run, schema)


def sample_edits(text: str = "text") -> Column:
    """Three edits of any text: its begin put in after a quarter, a fiftieth taken out of the
    middle, and ten characters after three quarters replaced by those at its begin, doubled."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.char_length(whole)

    def edit(start: Column, length: Column, new: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), new.alias("text"))

    return F.array(
        edit(F.floor(n / 4), F.lit(0), F.substring(whole, 1, 20)),
        edit(F.floor(n / 2), F.least(F.floor(n / 50), F.lit(400)), F.lit("")),
        edit(F.floor(3 * n / 4), F.lit(10), F.repeat(F.substring(whole, 1, 10), 2)),
    )
