"""Token ids by the tokenizers library, one chunk of text at a time.

No token of these vocabularies crosses the places where a text is cut here (see
``chunks``), so the ids of a text are the ids of its chunks in order; a bounded memo
per worker keeps the ids of chunks seen before. The vocabulary file's path is a
parameter; it is read on each worker and never copied.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lamella.llm.common import kept

#: Chunks that a worker remembers, those used last, at about 40 bytes each.
MEMO_CHUNKS = 400_000
#: Characters of the texts whose chunks are looked up together, and new chunks that are encoded in one
#: call (the library takes some hundred bytes a character meanwhile).
TOGETHER = 1 << 21
PER_CALL = 1 << 11

#: A blank between two characters that are no white space starts a token of its own word.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line ends, and what stands between chunks here.
OTHER = re.compile("[\0" + "".join(re.escape(c) for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
#: Chunks that keep their tokens between two line ends.
FIRM = re.compile(r" ?\S(?:.*\S)?\Z", re.S)
#: Latin letters, and the ASCII punctuation that starts a token of its own after one of them. Normalising leaves
#: these letters letters; that of U+0130 would leave a mark, which is no letter.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
TAIL = f"([{LETTERS}])([!-/:-@\\[-^`{{-~])"


#: The ids of each of many chunks.
IDS = pa.large_list(pa.uint32())


def encoder(path: str, spaces: bool, plain: bool = False) -> ChunkEncoder:
    """One encoder per worker process, so that its memo outlives a task."""
    return kept(("encoder", path, spaces, plain), lambda: ChunkEncoder(path, spaces, plain))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of whole texts. ``spaces``: the vocabulary has tokens for white space (byte-level
    BPE); otherwise white space only separates words. ``plain``: strings of special tokens are
    ordinary text; otherwise they are those tokens, as the library has it by default, and the
    rare texts that hold one are encoded whole."""

    def __init__(self, path: str, spaces: bool, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else self.tokenizer.get_added_tokens_decoder().values()
        #: Added tokens that are looked for in the text as it stands, and in the normalised one.
        self.literal = [t.content for t in added if not t.normalized]
        self.normalised = re.compile("|".join(re.escape(t.content) for t in added if t.normalized) or r"(?!)", re.IGNORECASE)
        self.spaces = spaces
        #: What the worker remembers, last used first: chunks and their ids.
        self.memo, self.ids = pa.array([], pa.large_string()), pa.array([], IDS)
        #: Words of letters, which can be encoded in one call without marks between them.
        self.word = f"^{' ' if spaces else ''}[{LETTERS}]+$"
        #: Stands between chunks that are encoded in one call; it is a token of its own there.
        self.mark = "\n" if spaces else "\x01"
        self.joint = self.mark if spaces else f" {self.mark} "
        #: Whether a token begins with a blank (``spaces``) or ends a word: it does so once in a word of letters.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.edge[k] = token.startswith("\u0120") if spaces else token.endswith("</w>")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def cut(self, text: str) -> str | None:
        """The text with a NUL between its chunks; None if other white space than single blanks and line
        ends between words, or a NUL, asks for ``pieces``."""
        if not self.spaces:
            return None if "\0" in text else text.replace("\n", "\0").replace(" ", "\0")
        if OTHER.search(text) or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[:1].isspace() or text[-1:].isspace():
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0")

    def pieces(self, text: str) -> list[str]:
        """The chunks of any text."""
        if not self.spaces:
            return text.replace("\n", " ").split(" ")
        first, *rest = SAFE.split(text)
        return [first, *(" " + x for x in rest)]

    def whole(self, text: str) -> bool:
        """Whether the text may hold an added token, so that it has to be encoded as it stands."""
        return any(x in text for x in self.literal) or self.normalised.search(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ((_, ids),) = self.encode_all([(None, text)])
        return ids

    def encode_all(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, ids) for each (key, text). New chunks of ``TOGETHER`` characters of text are encoded in one call."""
        held: list[tuple] = []
        size = 0
        for key, text in rows:
            held.append((key, text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, rows: list[tuple]) -> Iterator[tuple]:
        whole = [self.whole(text) for _, text in rows]
        even = [None if alone else self.cut(text) for alone, (_, text) in zip(whole, rows, strict=True)]
        uneven = [self.pieces(text) for alone, x, (_, text) in zip(whole, even, rows, strict=True) if x is None and not alone]
        cut = pc.replace_substring_regex(pa.array([x for x in even if x is not None], pa.large_string()), pattern=TAIL, replacement="\\1\0\\2")
        lists = pc.split_pattern(cut, "\0")
        chunks = pa.concat_arrays([lists.flatten(), pa.array([x for some in uneven for x in some], pa.large_string())]).dictionary_encode()
        del cut
        edges = np.concatenate([lists.offsets.to_numpy(), len(lists.flatten()) + np.cumsum(np.array([len(x) for x in uneven], np.int64))])
        distinct = self._folded(chunks.dictionary)
        known, places = self._known(distinct.dictionary), distinct.indices.take(chunks.indices)
        lengths = np.diff(known.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(lengths[places.to_numpy()])])[edges].tolist()
        raw = memoryview(known.take(places).flatten().to_numpy()).cast("B")
        turns, later = iter(range(len(lists))), iter(range(len(lists), len(lists) + len(uneven)))
        for (key, text), alone, x in zip(rows, whole, even, strict=True):
            if alone:
                yield key, self._ids(text).tobytes()
            else:
                turn = next(later) if x is None else next(turns)
                yield key, bytes(raw[4 * ends[turn] : 4 * ends[turn + 1]])

    def _folded(self, chunks: pa.Array) -> pa.DictionaryArray:
        """The chunks; words of Latin letters with a-z for A-Z where the vocabulary does not tell them apart."""
        if not self.spaces:
            chunks = pc.if_else(pc.match_substring_regex(chunks, self.word), pc.ascii_lower(chunks), chunks)
        return chunks.dictionary_encode()

    def _known(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of these distinct chunks, by the memo or else encoded now; they head the memo afterwards."""
        at = pc.index_in(chunks, value_set=self.memo)
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(places < 0)
        places[fresh] = len(self.memo) + np.arange(len(fresh))
        found = pa.concat_arrays([self.ids, self._learn(chunks.take(pa.array(fresh)))]).take(pa.array(places))
        unused = np.ones(len(self.memo) + len(fresh), bool)
        unused[places] = False
        rest = pa.array(np.flatnonzero(unused[: len(self.memo)])[: max(0, MEMO_CHUNKS - len(chunks))])
        head = min(len(chunks), MEMO_CHUNKS)
        self.memo = pa.concat_arrays([chunks[:head], self.memo.take(rest)])
        self.ids = pa.concat_arrays([found[:head], self.ids.take(rest)])
        return found

    def _learn(self, new: pa.Array) -> pa.Array:
        """The ids of these distinct chunks, encoded ``PER_CALL`` at a time."""
        is_word = pc.match_substring_regex(new, self.word).to_numpy(zero_copy_only=False)
        order, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for some, words in ((np.flatnonzero(is_word), True), (np.flatnonzero(~is_word), False)):
            for start in range(0, len(some), PER_CALL):
                at = some[start : start + PER_CALL]
                chunks = new.take(pa.array(at)).to_pylist()
                found = self._encode_words(chunks) if words else None
                n, raw = found or self._encode_new(chunks)
                order.append(at)
                sizes.append(n)
                ids.append(raw)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        each = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(ids), pa.uint32()))
        return each.take(pa.array(np.argsort(np.concatenate(order))))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """How many ids each of these words of letters has, and all of them, by one call; None if the ids do
        not tell where each ends."""
        ids = self._ids(("" if self.spaces else " ").join(words))
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return None
        return np.diff(edges, append=len(ids)) if self.spaces else np.diff(edges, prepend=-1), ids

    def _encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these distinct chunks has, and all of them."""
        plain = [x for x in new if FIRM.match(x) and self.mark not in x]
        ids = self._ids(self.joint.join(plain))
        ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
        found, start = {}, 0
        for x, end in zip(plain, ends, strict=bool(plain)):
            found[x] = ids[start:end]
            start = end + 1
        each = [found[x] if x in found else self._ids(x) for x in new]
        return np.array([len(x) for x in each], np.int64), np.concatenate(each)

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")
