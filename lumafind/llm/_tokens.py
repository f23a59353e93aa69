"""Token ids of whole texts with a public tokenizer file, memoised by piece.

Both pre-tokenizers end a token wherever a visible character is followed by a space or newline, so a text
is encoded piece by piece and the pieces' ids are joined: Arrow splits the texts and finds the distinct
pieces, only these are looked up. Texts with rarer white space go to the library whole, unless the tokenizer
drops white space altogether. Pieces of plain Latin text are split by the
tokenizer's own pattern here and only their runs go to the library's BPE model; all others pass through the
library's whole chain. The memos are bounded and only save time.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ._common import kept, let_go

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO = 500_000
#: Longest word kept in a memo.
LONGEST = 100
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_RARE_SPACE = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN_ON = r"^[ \n]|[ \n]$|  |\n\n|\n |\x00"
_LATIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-\u024f]*").fullmatch
#: The default pattern of byte-level pre-tokenizers, which their files don't spell out.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks that may follow a word's letters; together they are one run of either pattern.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def _byte_letters() -> str:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return "".join(letters[b] for b in range(256))


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """encode(texts) -> the ids of all texts in a row, unsigned 32-bit, and where each text's begin."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        parts = json.loads(self.tokenizer.to_str())
        first = parts["pre_tokenizer"].get("pretokenizers", [parts["pre_tokenizer"]])[0]
        self.drops_space = first["type"] == "Split"
        self.runs = regex.compile(first["pattern"]["Regex"] if self.drops_space else _BYTE_LEVEL).findall
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[str, bytes] = {}
        self.run_memo: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def run_ids(self, run: str) -> bytes:
        if run.isascii() and run.isalpha():
            shown = run
        else:
            shown = codecs.charmap_decode(run.encode(), "strict", self.letters)[0]
        return b"".join([self.four[t.id] for t in self.model.tokenize(shown)])

    def _plain(self, piece: str) -> bytes:
        """A piece of Latin text; mostly letters, maybe after a space, and then marks, which needs no pattern."""
        if self.drops_space:
            piece = piece.lower()
        core = piece.rstrip(_MARKS)
        if (core[1:] if core[:1] == " " else core).isalpha():
            runs = (core,) if core == piece else (core, piece[len(core) :])
        else:
            runs = self.runs(piece)
        out = []
        for run in runs:
            ids = self.run_memo.get(run)
            if ids is None:
                ids = self.run_ids(run)
                if len(run) <= LONGEST:
                    self.run_memo[run] = ids
            out.append(ids)
        return b"".join(out)

    def units(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the memo lacks."""
        if len(self.run_memo) > MEMO:
            self.run_memo.clear()
        plain = [_LATIN(p) is not None and "<|" not in p for p in pieces]
        rest = iter(self.whole([p for p, yes in zip(pieces, plain) if not yes]))
        return [self._plain(p) if yes else next(rest) for p, yes in zip(pieces, plain)]

    def _known(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct words. A byte-level key stands for the word after one space; one that begins with a
        newline or, after a zero byte, anything else stands for exactly that."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        found = list(map(self.memo.get, keys))
        #: Millions of new lists and strings would set off collections that find nothing.
        collects = gc.isenabled()
        gc.disable()
        new = [k for k, raw in enumerate(found) if raw is None]
        shown = [keys[k] if self.drops_space else keys[k][1:] if keys[k][:1] == "\0" else keys[k] if keys[k][:1] == "\n" else " " + keys[k] for k in new]
        for k, raw in zip(new, self.units(shown)):
            found[k] = raw
            if len(keys[k]) <= LONGEST:
                self.memo[keys[k]] = raw
        if collects:
            gc.enable()
        return found

    def _coded(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of words: each distinct word is looked up once, and its ids are copied to its places."""
        coded = words.flatten().dictionary_encode()
        raws = self._known(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        pool = np.frombuffer(b"".join(raws), "<u4")
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        after = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(begins[codes] - after[:-1], n) + np.arange(after[-1])]
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
        return ids, after[ends]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A null text is empty. Callers bound the bytes of a call."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.drops_space:
            return self._coded(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
        rare = pc.match_substring_regex(texts, _RARE_SPACE)
        odd = pc.or_(rare, pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _RUN_ON)))
        zero, none = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        plain = pc.binary_join_element_wise(zero, pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), none)
        ids, bounds = self._coded(pc.split_pattern(plain, " "))
        if not pc.any(odd).as_py():
            return ids, bounds
        k, parts = 0, []
        for is_odd, is_rare, text in zip(odd.to_pylist(), rare.to_pylist(), pc.if_else(odd, texts, None).to_pylist()):
            if is_odd:
                raw = self.whole([text])[0] if is_rare else b"".join(self._known(["\0" + p for p in _PIECE.findall(text)]))
                parts.append(np.frombuffer(raw, "<u4"))
            else:
                parts.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_LOADED: dict[tuple, Encoder] = kept("tokens", {})


def encoder(path: str, kind: type = Encoder) -> Encoder:
    """One encoder a worker process and file."""
    let_go("tokens")
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]
