"""Tokenizers for workers: loaded once a process, one thread each."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_loaded: dict = {}


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str, controls: tuple[str, ...] = ()):
    """A ``tokenizers`` tokenizer, with further control tokens that texts can't hold."""
    key = (name, controls)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name if "/" in name else vocabulary_path(name)
        found = Tokenizer.from_file(path)
        if controls:
            found.add_special_tokens(list(controls))
        _loaded[key] = found
    return _loaded[key]


#: Signs that one after the other make one word of their own behind letters.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters that lower-casing and normalising may treat in ways of their own.
_HARD = r"[^\x{0000}-\x{024F}]|\x{0130}"


class WordEncoder:
    """Ids of whole texts, for a tokenizer that ignores case, drops white space, never
    joins what white space parts and marks the last token of a word (``</w>``).

    Spaces and line feeds cut a text into pieces (other white space stays inside its
    piece). Plain letters with signs behind are two words to such a tokenizer: the piece
    is looked up as these two parts, any other piece as a whole. The ids of parts are
    remembered once they are met in a second batch, in two generations: when the young
    one is full it becomes the old one, and what is met again comes back from there. All that is done for every piece runs
    in Arrow and numpy; Python sees the distinct parts of a batch.
    """

    def __init__(self, tokenizer, limit: int = 300_000):
        self.tokenizer, self.limit = tokenizer, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met, self.marks = bytearray(1 << 22), 0  # by hash: parts of earlier batches
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[str], others: list[str]) -> dict[str, bytes]:
        """Encodes new words of plain letters thousands at a time, as one text; the rest
        one by one."""
        new: dict[str, bytes] = {}
        blocks = [words[k : k + 4000] for k in range(0, len(words), 4000)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(block):
                raise ValueError("the tokenizer does not mark word ends")
            ids, a = ids.tobytes(), 0
            for word, b in zip(block, ends):
                new[word] = ids[a:b]
                a = b
        for x, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            new[x] = np.array(e.ids, "<u4").tobytes()
        self._keep(new)
        return new

    def _keep(self, new: dict[str, bytes]) -> None:
        met, young, last = self.met, self.young, len(self.met) - 1
        if self.marks > last // 4:
            self.met = met = bytearray(last + 1)
            self.marks = 0
        for x, ids in new.items():
            k = hash(x) & last
            if met[k]:
                young[x] = ids
            else:
                met[k] = 1
                self.marks += 1

    def _ids(self, parts: list[str], plain: list[bool]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        missing = [k for k, y in enumerate(found) if y is None]
        words, others = [], []
        for k in missing:
            x = parts[k]
            if (y := old.get(x)) is not None:
                young[x] = found[k] = y
            else:
                (words if plain[k] else others).append(x)
        if words or others:
            new = self._learn(words, others)
            for k in missing:
                if found[k] is None:
                    found[k] = new[parts[k]]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        body = pc.ascii_rtrim(distinct, characters=_SIGNS)
        plain = pc.and_(pc.utf8_is_alpha(body), pc.invert(pc.match_substring_regex(body, _HARD)))
        part = pc.if_else(plain, pc.utf8_lower(body), distinct).dictionary_encode()
        is_plain = np.zeros(len(part.dictionary), bool)
        first, flags = part.indices.to_numpy(), plain.to_numpy(zero_copy_only=False)
        is_plain[first] = flags
        blobs = self._ids(part.dictionary.to_pylist(), is_plain.tolist())

        second = np.full(len(distinct), len(blobs))
        signed = np.flatnonzero(flags & (pc.binary_length(body).to_numpy() < pc.binary_length(distinct).to_numpy()))
        if len(signed):
            at = pa.array(signed)
            tails = [x[len(b) :] for x, b in zip(distinct.take(at).to_pylist(), body.take(at).to_pylist())]
            kinds = {x: k for k, x in enumerate(dict.fromkeys(tails))}
            second[signed] = len(blobs) + 1 + np.array([kinds[x] for x in tails])
            blobs = [*blobs, b"", *self._ids(list(kinds), [False] * len(kinds))]
        else:
            blobs = [*blobs, b""]

        held = pa.array(blobs, pa.binary())
        _, ends, pool = held.buffers()
        start = np.frombuffer(ends, np.int32, len(blobs) + 1) // 4
        size, pool = np.diff(start), np.frombuffer(pool, "<u4", start[-1]) if start[-1] else np.zeros(0, "<u4")
        order = np.empty(2 * len(code), np.int64)
        order[0::2], order[1::2] = first[code], second[code]
        n = size[order]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(end[-1]) + np.repeat(start[order] - end[:-1], n)]
        cut = pieces.offsets.to_numpy()
        return ids, np.diff(end[2 * (cut - cut[0])])


_encoders: dict = {}


def word_encoder(name: str) -> WordEncoder:
    """This process's encoder; what it has learned serves all its tasks."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(load(name))
    return _encoders[name]
