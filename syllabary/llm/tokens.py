"""Token ids of whole texts, as packed bytes.

A text is cut before every blank (and line feed, where the vocabulary is of bytes) that follows a character which is no white
space. A pre-tokenizer that splits at white space yields the same pieces from each chunk alone as from the whole text, so ids of a
chunk are looked up where it was seen before and only new chunks reach the tokenizer, many in one call. A text that holds one of the
vocabulary's added tokens goes to the tokenizer whole, which cuts it there and gives that token's id.
"""

from __future__ import annotations

import codecs
import json
import os
import re

import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by one generation of the lookup, and characters of a chunk that is kept; two generations live at once, which bounds
#: a worker's memory.
KEPT_CHUNKS, LONGEST_KEPT = 800_000, 64
#: Runs of marks whose ids are kept.
MARKS_KEPT = 10_000
#: New chunks that are joined into one string for the tokenizer.
JOINED = 256

_loaded: dict[str, ChunkTokenizer] = {}
#: What ``\\s`` is in Python, for Arrow: a blank beside another white space.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE_AT_EDGE = f"{_SPACES} | {_SPACES}"
_CHUNKS = re.compile(r"(?<=\S)(?= )")
_MARK = "~"
#: Letters of two Latin blocks, then marks: what every pre-tokenizer at hand cuts in at most two.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?|*$%&#]*")
_LETTERS = "".join(x for x in map(chr, range(256)) if _PLAIN.fullmatch(x))
_MARKS = ".,;:!?|*$%&#"
#: Words that byte-level pre-tokenizers take as one piece, or as a line feed and one.
_BARE = re.compile(r"\n?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_INNER_LINE = f"({_SPACES.replace('[', '[^', 1)})\n"


class ChunkTokenizer:
    """Encodes texts to little-endian unsigned 16-bit ids (32-bit for larger vocabularies)."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = tuple(t.content for t in added)
        self.always_whole = any(t.normalized for t in added)  # such a token may stand for other spellings of it
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        layout = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.starts, self.mark, self.ends, self.bare = None, None, None, None
        if layout.get("type") == "ByteLevel" and layout.get("use_regex"):
            self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
            self.starts[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
            if "Ċ" in vocabulary:
                # The same model behind a pre-tokenizer that needs no pattern: bytes are spelt as in the vocabulary, 0 parts pieces.
                self.bare = Tokenizer(self.tokenizer.model)
                self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
                self.begins = self.starts.copy()
                self.begins[vocabulary["Ċ"]] = True
                as_is, others = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
                self.spelt = " " + "".join(chr(i if i in as_is else next(others)) for i in range(256))[1:]
        elif len(mark := self._ids(_MARK)) == 1 and self._ids(f" a {_MARK} b") == self._ids("a") + mark + self._ids("b"):
            self.mark = mark[0]
            suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
            if suffix and self._pieces_as_expected():
                self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        probe = ["aB", _LETTERS, f"\n{_LETTERS}", "\nab", "é", "\nÀ"]
        if self.bare and self._joined(probe, bare=True) != self._one_by_one([w if w[0] == "\n" else f" {w}" for w in probe]):
            self.bare = None
        # Whether line feeds and tabs are as good as blanks.
        self.drops_space = self.mark is not None and self._ids("\ta\n\n b\t \nc\n") == self._ids("a b c")
        self.cuts_marks = self._pieces_as_expected() and (self.starts is not None or self.ends is not None)
        self.lowers = self.ends is not None and self._ids(_LETTERS) == self._ids(_LETTERS.lower()) and _LETTERS.lower() == pc.utf8_lower(_LETTERS).as_py()
        self.marks: dict[str, bytes] = {}
        #: No generation holds more, but for the chunks of one call.
        self.kept = kept
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces_as_expected(self) -> bool:
        """Whether the tokenizer takes a run of letters, and one of marks after it, as one piece each."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return all(len(cut(x)) == n for x, n in (("abéß", 1), ("ab.", 2), ("àb,!|", 2), ("Zürich?", 2), (" Ab*$%&#", 2), (" é;: a", 3), (_LETTERS, 1), (_LETTERS + _MARKS, 2)))

    def _by_ends(self, words: list[str]) -> list[bytes] | None:
        """Ids of plain words from the marks at their ends: one for the letters, one for what follows them."""
        import numpy as np

        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False)
        out, size = [], self.dtype.itemsize
        for group, ids in zip(groups, found, strict=True):
            ids = np.array(ids.ids, self.dtype)
            at = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([1 if w[-1].isalpha() else 2 for w in group])
            if len(at) != last[-1]:
                return None
            edges, packed = [0, *at[last - 1].tolist()], ids.tobytes()
            out += [packed[a * size : b * size] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _joined(self, words: list[str], bare: bool = False) -> list[bytes] | None:
        """Ids of words that hold no blank, each as it is after one blank (``bare``: words as in ``_BARE``, as they are after a blank
        or with their line feed); None where the joined ids can't be told apart."""
        import numpy as np

        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        between = "\0 " if bare else " " if self.starts is not None else f" {_MARK} "
        joined = [between + between.join(x) for x in groups]
        if bare:
            joined = [codecs.charmap_decode(x.replace("\0 \n", "\0\n\0").encode(), "strict", self.spelt)[0] for x in joined]
        found = (self.bare if bare else self.tokenizer).encode_batch_fast(joined, add_special_tokens=False)
        starts = self.begins if bare else self.starts
        out = []
        for group, ids in zip(groups, found, strict=True):
            ids = np.array(ids.ids, self.dtype)
            at = np.flatnonzero(starts[ids] if starts is not None else ids == self.mark)
            if len(at) != len(group):
                return None
            skip, size = int(self.starts is None), self.dtype.itemsize
            packed, ends = ids.tobytes(), [*at[1:].tolist(), len(ids)]
            out += [packed[(a + skip) * size : b * size] for a, b in zip(at.tolist(), ends, strict=True)]
        return out

    def _is_line(self, word: str) -> bool:
        """Whether a word stands for itself, where others stand for what they are after a blank."""
        return self.bare is not None and word.lstrip(" ").startswith("\n")

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of different words that the younger generation lacks; it takes up those that are not too long to stay there."""
        if len(self.new) + len(missing) > self.kept and self.new:
            self.old, self.new = self.new, {}
        learnt = {w: ids for w, ids in zip(missing, map(self.old.get, missing), strict=True) if ids is not None} if self.old else {}
        if learnt:
            missing = [w for w in missing if w not in learnt]
        long = {w for w in missing if len(w) > LONGEST_KEPT}
        if self.ends is not None:
            plain = [w for w in missing if _PLAIN.fullmatch(w)]
            if (ids := self._by_ends(plain)) is not None:
                learnt.update(zip(plain, ids, strict=True))
                missing = [w for w in missing if w not in learnt]
        if self.bare:
            plain = [w for w in missing if _BARE.fullmatch(w)]
            if (ids := self._joined(plain, bare=True)) is not None:
                learnt.update(zip(plain, ids, strict=True))
                missing = [w for w in missing if w not in learnt]
        odd = [w for w in missing if not w or " " in w or (_MARK in w and self.starts is None) or (self.bare and w[0] == "\n")]
        plain = list(set(missing).difference(odd)) if odd else missing
        ids = self._joined(plain) if self.starts is not None or self.mark is not None else None
        if ids is None:
            odd, plain, ids = odd + plain, [], []
        learnt.update(zip(plain, ids, strict=True))
        learnt.update(zip(odd, self._one_by_one([w if self._is_line(w) else " " + w for w in odd]), strict=True))
        self.new.update({w: ids for w, ids in learnt.items() if w not in long} if long else learnt)
        return learnt

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. What Arrow needed for that goes back to the system, as workers wait for long with what they hold."""
        try:
            return self._encode(texts)
        finally:
            pa.default_memory_pool().release_unused()

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.always_whole or any(x in t for x in self.added)]
        if whole:
            kept = dict(zip(whole, self._one_by_one([texts[i] for i in whole]), strict=True))
            others = [t for i, t in enumerate(texts) if i not in kept]
            rest = iter(self._encode(others) if others else ())
            return [kept[i] if i in kept else next(rest) for i in range(len(texts))]
        if self.drops_space:
            return self._by_words(texts, begun=None)
        edged = pc.match_substring_regex(pa.array(texts, pa.string()), _SPACE_AT_EDGE).to_pylist()
        even, uneven = ([i for i, x in enumerate(edged) if x == y] for y in (False, True))
        evens, unevens = ([texts[i] for i in x] for x in (even, uneven))
        if self.bare:  # lines are cut too, as if a blank stood before each
            evens = pc.replace_substring_regex(pa.array(evens, pa.string()), _INNER_LINE, "\\1 \n").to_pylist()
        begun = self._one_by_one([t.split(" ", 1)[0] for t in evens] + [_CHUNKS.split(t, maxsplit=1)[0] for t in unevens])
        out = dict(zip(even, self._by_words(evens, begun[: len(even)]), strict=True))
        out.update(zip(uneven, self._by_chunks(unevens, begun[len(even) :]), strict=True))
        return [out[i] for i in range(len(texts))]

    def _by_words(self, texts: list[str], begun: list[bytes] | None) -> list[bytes]:
        """Ids of texts that are cut at every blank; ``begun``: ids of what stands before each one's first blank, where they are
        other than after a blank."""
        if not texts:
            return []
        import numpy as np

        if begun is None:
            texts = [t.replace("\n", " ").replace("\t", " ") for t in texts]
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words, edges = cut.values, cut.offsets.to_numpy()
        if begun is not None:
            rest = np.ones(len(words), bool)
            rest[edges[:-1]] = False
            words = pc.if_else(pa.array(rest), words, pa.scalar(None, words.type))
        coded = words.dictionary_encode()
        ids, at = self._ids_of(coded.dictionary), coded.indices
        if begun is not None:
            at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
            at[edges[:-1]] = np.arange(len(ids), len(ids) + len(begun))
            at = pa.array(at)
        # The ids of all words one after the other, of which each text has a part.
        joined = pa.concat_arrays([ids, pa.array(begun or [], pa.large_binary())]).take(at)
        ends, packed = np.frombuffer(joined.buffers()[1], np.int64)[edges].tolist(), memoryview(joined.buffers()[2] or b"")
        return [bytes(packed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of different words. Letters with marks after them are looked up as two pieces, so that fewer are new."""
        if not self.cuts_marks:
            return self._looked_up(words)
        letters, marks = pc.utf8_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        both = pc.add(pc.binary_length(letters), pc.binary_length(marks))
        plain = pc.and_(pc.equal(both, pc.binary_length(words)), pc.greater(pc.binary_length(letters), 0))
        marks = pc.if_else(plain, marks, "").dictionary_encode()
        if self.lowers:
            letters = pc.utf8_lower(letters)
        pieces = pc.if_else(plain, letters, words).dictionary_encode()
        after = pa.array([self._packed(x) for x in marks.dictionary.to_pylist()], pa.large_binary())
        return pc.binary_join_element_wise(self._looked_up(pieces.dictionary).take(pieces.indices), after.take(marks.indices), pa.scalar(b"", pa.large_binary()))

    def _packed(self, marks: str) -> bytes:
        """Ids of marks that follow a letter."""
        if marks not in self.marks:
            if len(self.marks) > MARKS_KEPT:
                self.marks.clear()
            self.marks[marks] = self._one_by_one([marks])[0]
        return self.marks[marks]

    def _looked_up(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        found = words.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.new.get, found))  # each word is looked for once, as most of the time goes into that
        if missing := [w for w, x in zip(found, ids, strict=True) if x is None]:
            learnt = self._learn(missing)
            ids = [learnt[w] if x is None else x for w, x in zip(found, ids, strict=True)]
        return pa.array(ids, pa.large_binary())

    def _by_chunks(self, texts: list[str], begun: list[bytes]) -> list[bytes]:
        """Ids of texts of which some blanks follow or precede white space; ``begun``: ids of the first chunk of each."""
        cut = [[x if self._is_line(x) else x[1:] for x in _CHUNKS.split(text)[1:]] for text in texts]
        words = set().union(*cut)
        known = {w: self.new[w] for w in words if w in self.new}
        get = (known | self._learn(list(words.difference(known)))).__getitem__
        return [first + b"".join(map(get, rest)) for first, rest in zip(begun, cut, strict=True)]


def load(path: str) -> ChunkTokenizer:
    """The tokenizer of a file, once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
