"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only around an edit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame

KNOWN = 300_000
RESULT = "n_pretokens bigint, n_tokens_before bigint, n_tokens bigint, n_reencoded bigint"


class PreTokenizer:
    """Splits text into pre-tokens that cover it, and counts the tokens of each."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = len(self.encoding.encode_ordinary(piece))
        return list(map(known.__getitem__, pieces))


@lru_cache(maxsize=1)
def pretokenizer(path: str, pattern: str) -> PreTokenizer:
    return PreTokenizer(path, pattern)


class CountTree:
    """Sums of characters and tokens over a document's leaves; a leaf starts at a pre-token.

    At first every pre-token is a leaf. An edit puts what it re-encodes into one leaf and empties the
    others that it touched, so the tree keeps its form and only their ancestors change.
    """

    def __init__(self, text: str, tokenizer: PreTokenizer):
        self.text, self.tokenizer = text, tokenizer
        pieces = tokenizer.pattern.findall(text)
        self.leaves = len(pieces)
        self.size = 1 << max(0, (max(self.leaves, 1) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + self.leaves, 0] = np.fromiter(map(len, pieces), np.int64, self.leaves)
        self.sums[self.size : self.size + self.leaves, 1] = tokenizer.count(pieces)
        width = self.size
        while width > 1:
            self.sums[width // 2 : width] = self.sums[width : 2 * width : 2] + self.sums[width + 1 : 2 * width : 2]
            width //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if position >= start + left:
                start += left
                node += 1
        return node - self.size, start

    def put(self, leaf: int, characters: int, tokens: int) -> None:
        node = leaf + self.size
        change = np.array([characters, tokens]) - self.sums[node]
        while node and change.any():
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end; the number of characters that were encoded again.

        A pre-token depends on its own characters and at most the next two, so encoding starts at the
        leaf that holds the second character before the edit. It stops after the edit as soon as a
        pre-token ends where an old leaf ends: from there on the text and its pre-tokens are the old ones.
        """
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        shift = len(new) - (end - start)
        old_length = len(self.text)
        self.text = self.text[:start] + new + self.text[end:]
        if old_length == 0:
            self.__init__(self.text, self.tokenizer)
            return len(self.text)
        leaf, begin = self.leaf_at(max(0, min(start - 2, old_length - 1)))
        last, old = leaf, begin  # leaves before `last` end at `old`, in old positions
        pieces, at = [], begin
        for match in self.tokenizer.pattern.finditer(self.text, begin):
            pieces.append(match[0])
            at = match.end()
            if at >= start + len(new):
                while old < at - shift:
                    old += int(self.sums[last + self.size, 0])
                    last += 1
                if old == at - shift and old >= end and last > leaf:
                    break
        else:
            last = self.leaves
        self.put(leaf, at - begin, sum(self.tokenizer.count(pieces)))
        for other in range(leaf + 1, last):
            self.put(other, 0, 0)
        return at - begin


def count_edited(docs: DataFrame, tokenizer: str, pattern: str, id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts of every whole text before and after its edits: id, n_pretokens, n_tokens_before, n_tokens, n_reencoded.

    ``edits`` is an array of (start, end, text): characters from start to end are replaced, each edit
    seeing the text that the ones before it left. Positions beyond the text are taken as its end.
    n_reencoded is how many characters the edits made the tokenizer read again.

    Nulls: a null text is an empty one, null edits are none, a null edit is left out, a null new text
    deletes. Repeated rows are counted each; an empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"), docs[edits].alias("edits"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for i in range(len(batch)):
                tree = CountTree(batch["text"][i].as_py() or "", pretokenizer(tokenizer, pattern))
                leaves, before = tree.leaves, tree.tokens
                read = sum(tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in batch["edits"][i].as_py() or [] if e)
                out.append((leaves, before, tree.tokens, read))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 4)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", "n_pretokens", "n_tokens_before", "n_tokens", "n_reencoded"])

    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id)
