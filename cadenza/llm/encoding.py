"""Token ids of texts by a tokenizer file, with the ids of chunks kept per worker."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: white space as tokenizers see it, without the separators that only Python counts
_TWO_SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

#: letters that end in an ASCII letter, then a mark that no tokenizer joins to it; a letter such as İ would end in a mark of its own once lowered
_HEAD = re.compile(r"(\s?[^\W\d_]*[A-Za-z])([.,!?;:*$%&#|].*)", re.DOTALL)


class Encoder:
    """Ids as little-endian bytes of `dtype`, equal to those of the library for each whole text.

    Both kinds of tokenizer in use decide tokens between one change from a
    solid character to white space and the next, so a text is cut into chunks
    there, and the different chunks of a batch are looked up. A new chunk is
    put together from its letters and the marks behind them, which may be known
    as well; what is new of these goes through the library many at a time, with
    a special token between them. At most `keep` chunks are held; later ones
    are forgotten after their batch.

    Special tokens in a text are encoded as such, as the library does by
    default; with `plain` their strings are ordinary text.
    """

    def __init__(self, path: str, keep: int, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.direct = Tokenizer.from_file(path)
        self.direct.encode_special_tokens = plain
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), key=len)
        self.stop = self.tokenizer.token_to_id(self.special[0]) if self.special else None
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.keep = keep
        self.spaced: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.direct.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _ids(self, parts: list[str], group: int = 256) -> list[bytes]:
        """Ids of parts without special tokens in them."""
        if not parts:
            return []
        if self.stop is None:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        between = self.special[0]
        joined = [between.join(parts[i:i + group]) + between for i in range(0, len(parts), group)]
        flat = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.stop) * self.dtype.itemsize
        data, at, out = flat.tobytes(), 0, []
        for end in ends.tolist():
            out.append(data[at:end])
            at = end + self.dtype.itemsize
        return out

    def _known(self, known: dict[str, bytes], chunks: list[str], spaced: bool) -> list[bytes]:
        """The ids of each chunk; chunks without a place in `known` are learned and, while there is room, kept."""
        got = list(map(known.get, chunks))
        missing = dict.fromkeys(c for c, g in zip(chunks, got, strict=True) if g is None) if None in got else None
        if not missing:
            return got
        plain, cut = [], []
        for c in missing:
            if c[-1:].isalpha() or not (m := _HEAD.fullmatch(c)):
                plain.append(c)
            else:
                cut.append((c, m[1], m[2]))
        if cut:
            plain += {h for _, h, _ in cut if h not in known and h not in missing}
            tails = [t for t in {t for _, _, t in cut} if t not in self.tails]
            if len(self.tails) > self.keep:
                self.tails, tails = {}, list({t for _, _, t in cut})
            self.tails.update(zip(tails, self._ids(tails), strict=True))
        forms = [c if c[:1] == "\n" else " " + c for c in plain] if spaced else plain
        fresh = dict(zip(plain, self._ids(forms), strict=True))
        for c, h, t in cut:
            fresh[c] = (fresh.get(h) or known[h]) + self.tails[t]
        if len(known) + len(fresh) <= self.keep:
            known.update(fresh)
        return [fresh[c] if g is None else g for c, g in zip(chunks, got, strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        column = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        if not len(column):
            return []
        odd = pc.match_substring_regex(column, _TWO_SPACES)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        rare = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        column_ = pc.if_else(odd, "", column) if len(rare) else column
        lists = pc.split_pattern(pc.replace_substring(column_, "\n", " \n"), " ")
        first = np.asarray(lists.offsets, np.int64)
        words = lists.flatten().dictionary_encode()
        names, codes = words.dictionary.to_pylist(), np.array(words.indices, np.int64)
        heads = [names[i] for i in codes[first[:-1]].tolist()]
        codes[first[:-1]] = len(names) + np.arange(len(heads))
        table = pa.array(self._known(self.spaced, names, True) + self._known(self.whole, heads, False), pa.large_binary())
        taken = table.take(pa.array(codes))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:][:len(codes) + 1][first].tolist()
        data = taken.buffers()[2].to_pybytes() if taken.buffers()[2] is not None else b""
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in rare.tolist():
            text = column[i].as_py()
            out[i] = self._one(text) if any(s in text for s in self.special) else b"".join(self._known(self.whole, _CHUNK.findall(text), False))
        return out


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, keep: int, plain: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    key = (path, keep, plain)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
