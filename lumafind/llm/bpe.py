"""BPE encoding and decoding that equals the tokenizers library on texts of any length.

A text longer than a leaf is encoded by tree concatenation: it is normalised once and halved down to leaves,
wherever the middle falls; the leaves of all long texts at hand are encoded in one batch, and level by level
the halves are joined. At each join a growing window of tokens is encoded again until it agrees with the left
part at the window's first token and with the right part at some later token. A token sequence is the BPE
encoding exactly if each neighbouring pair is, and no rule of the pre-tokenizer looks beyond a place where
both sides have the same token, so such a join is exact; a window that never agrees grows to the whole, which
is exact too. Tasks encode different texts side by side; the library's own threads stay off beside them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import documents, slices
from ._tokens import _LATIN, Encoder, encoder

#: Characters of a leaf, and tokens on either side of a join that are encoded again at first.
LEAF = 1024
REACH = 4
SUFFIX = "</w>"


class TreeEncoder(Encoder):
    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__(path)
        if not self.drops_space:
            raise ValueError("the pre-tokenizer must drop white space")
        self.leaf = leaf
        parts = json.loads(self.tokenizer.to_str())
        #: The same tokenizer for text that has been normalised, so that a cut can't change what lies beside it.
        self.bare = type(self.tokenizer).from_str(json.dumps(parts | {"normalizer": None}))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.token = [""] * size
        for t, k in vocabulary.items():
            self.token[k] = t
        #: Bytes that a token covers: a byte-level token has one character a byte.
        self.width = [len(t.removesuffix(SUFFIX)) for t in self.token]
        self.number = [str(k) for k in range(size)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        long = pc.greater(pc.utf8_length(texts), self.leaf)
        ids, bounds = super().encode(texts.filter(pc.invert(long)))
        if not pc.any(long).as_py():
            return ids, bounds
        trees = iter(self.trees(texts.filter(long).to_pylist()))
        k, parts = 0, []
        for is_long in long.to_pylist():
            if is_long:
                parts.append(next(trees))
            else:
                parts.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def trees(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of long texts. Those that spell a special token, which is cut out before all else, go to the
        library whole."""
        normal = [None if any(s in t for s in self.special) else self.normal(t) for t in texts]
        cuts = [None if t is None else self.halved(len(t)) for t in normal]
        leaves = self.leaves([t[a:b] for t, c in zip(normal, cuts) if c for a, b in zip(c, c[1:])])
        out, at = [], 0
        for whole, t, c in zip(texts, normal, cuts):
            if c is None:
                out.append(np.frombuffer(self.whole([whole])[0], "<u4"))
                continue
            own = leaves[at : at + len(c) - 1]
            at += len(c) - 1
            out.append(np.array(self.joined(t, c, own), np.uint32))
        return out

    def normal(self, text: str) -> str:
        """Normalised text, up to the extent of white space, which is dropped anyway."""
        if _LATIN(text) is not None:
            return text.replace("\n", " ").lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def halved(self, length: int) -> list[int]:
        """Edges of the leaves of a text, left to right."""
        cuts = [0, length]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]))})
        return cuts

    def leaves(self, texts: list[str]) -> list[list[int]]:
        """Normalised pieces in one batch: Latin ones, which normalising again leaves as they are, by words."""
        latin = [_LATIN(t) is not None and "<|" not in t for t in texts]
        ids, bounds = super().encode(pa.array([t for t, yes in zip(texts, latin) if yes], pa.large_string()))
        flat, edges = ids.tolist(), bounds.tolist()
        known = (flat[a:b] for a, b in zip(edges, edges[1:]))
        rest = iter(self._ids([t for t, yes in zip(texts, latin) if not yes]))
        return [next(known) if yes else next(rest) for yes in latin]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, text: str, cuts: list[int], leaves: list[list[int]]) -> list[int]:
        raw, bytes_at = text.encode(), [0]
        for a, b in zip(cuts, cuts[1:]):
            bytes_at.append(bytes_at[-1] + len(text[a:b].encode()))
        parts = [(a, b, ids) for a, b, ids in zip(bytes_at, bytes_at[1:], leaves)]
        while len(parts) > 1:
            pairs = [(left[0], right[1], self.join(raw, left, right)) for left, right in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(parts) - len(parts) % 2 :]
        return parts[0][2]

    def join(self, raw: bytes, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> list[int]:
        """Ids of two neighbouring parts (first byte, one past the last, ids) of a normalised text together."""
        (begin, _, first), (middle, end, last) = left, right
        tails, heads = [middle], []  # where the last tokens on the left begin, and those first on the right
        past = middle
        reach = REACH

        def further_left() -> None:
            at = tails[-1]
            while at > begin and raw[at - 1] == 32:
                at -= 1
            tails.append(at - self.width[first[-len(tails)]])

        def further_right() -> int:
            at = past
            while at < end and raw[at] == 32:
                at += 1
            heads.append(at)
            return at + self.width[last[len(heads) - 1]]

        while True:
            while len(tails) <= len(first) and (len(tails) <= reach or raw[tails[-1]] & 0xC0 == 0x80):
                further_left()
            while len(heads) < len(last) and (len(heads) < reach or (past < end and raw[past] & 0xC0 == 0x80)):
                past = further_right()
            i = len(tails) - 1
            a, b = (begin if i == len(first) else tails[i]), (end if len(heads) == len(last) else past)
            window = self._ids([raw[a:b].decode()])[0]
            if a == begin or window[0] == first[-i]:
                kept = first[: len(first) - i]
                if b == end:
                    return kept + window
                starts, at, found = {h: x for x, h in enumerate(heads)}, a, None
                for y, k in enumerate(window[:-1]):
                    while at < b and raw[at] == 32:
                        at += 1
                    x = starts.get(at)
                    if y and x is not None and last[x] == k:
                        found = y, x
                    at += self.width[k]
                if found:
                    return kept + window[: found[0]] + last[found[1] :]
            reach *= 2

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' strings joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: TreeEncoder = encoder(path, TreeEncoder)
        if tree.tokenizer.decoder is not None:
            raise ValueError("this tokenizer has a decoder; tokens can't be joined by spaces")
        sha = hashlib.sha256
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, sums, texts = [], [], []
                ids, bounds = tree.encode(batch.column(1))
                flat, edges = ids.tolist(), bounds.tolist()
                for a, b in zip(edges, edges[1:]):
                    own = flat[a:b]
                    sizes.append(b - a)
                    sums.append(sha(" ".join(map(tree.number.__getitem__, own)).encode()).hexdigest())
                    texts.append(sha(tree.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: TreeEncoder = encoder(path, TreeEncoder)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, bounds = tree.encode(batch.column(1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(tree.decode, lists.to_pylist()), pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids, decoded text. A null text is empty and has no ids; repeated rows
    and null doc_ids stay as they are; further columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(path), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_texts, with checksums in place of ids and texts, which then need not leave the task."""
    return docs.select("doc_id", "text").mapInArrow(_digest(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
