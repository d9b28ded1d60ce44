"""Encoding whole texts with a public tokenizer, each distinct unit about once per Python worker.

A unit is what stands between two cuts at spaces. Both vocabularies split a text at white space before they merge
(the byte-level one lets a word take one space before it), so the ids of a text are the ids of its units in turn.
Cuts are made only before a space whose left neighbour is not white space by the widest definition, so that no run of
white space is divided. No special token has a space in it, so that each one stands in one unit. The byte-level vocabulary's
texts are cut before single line ends too, which are words of their own: a line's last and first word are units then.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DIVIDED = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s) ")
_RUN = re.compile(r"\s\s")
_ENDS = ",.!?;:#%*&|<>$()[]\"/-_"
_ENDING = frozenset(_ENDS)
_LED = frozenset("\n ")


class _Known(dict):
    """Units and their ids; a unit met for the first time stands for itself and is noted in ``new``. Units of the older
    generation move up."""

    def __init__(self, older: dict[str, bytes]):
        super().__init__()
        self.older, self.new = older, []

    def __missing__(self, unit: str) -> bytes | str:
        found = self.older.get(unit)
        if found is None:
            self.new.append(unit)
            found = unit
        self[unit] = found
        return found


class Encoder:
    """ids(texts) gives little-endian unsigned 32-bit ids of each text as bytes, as the ``tokenizers`` library does with
    add_special_tokens=False.

    spaced: the vocabulary has words with a leading space (byte-level); otherwise it lower-cases and drops white space.
    most: units kept in each of two generations, so memory is bounded: when the young one is full it becomes the old one,
    and units still met move up again. Longer units than ``longest`` aren't kept.
    """

    def __init__(self, path: str, spaced: bool, most: int = 300_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced, self.most, self.longest = spaced, most, longest
        self.known = _Known({})
        self.tails: dict[str, bytes] = {}
        if spaced:  # the bytes of each id; a byte-level vocabulary writes a byte as one character
            vocabulary = self.library.get_vocab(with_added_tokens=False)
            self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def _encode(self, units: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _prepared(self, text: str) -> tuple[str, str | None, list[str]]:
        """The head of a text, whose id has no space before it, what follows as units with single spaces between (null: none),
        or the units themselves where they hold spaces. A unit stands for itself after a space, or alone where it begins with
        a line end or a space."""
        if self.spaced:
            if _RUN.search(text) is None:
                head, space, rest = text.replace("\n", " \n").partition(" ")
                return head, rest if space else None, []
            head, *parts = text.split(" ") if _DIVIDED.search(text) is None else _CUT.split(text)
            return head, None, [" " + x if x[:1] == "\n" or x[:1] == " " else x for x in parts]
        if "<|" not in text:  # special tokens are told by case; A-Z are lowered by the vocabulary anyway
            text = text.encode().lower().decode()
        return "", text.replace("\n", " "), []

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of single words of letters. The lower-casing vocabulary takes more time to prepare a text than to merge a word,
        so that words are joined by commas, whose id no letters have."""
        runs = [words[i : i + 300] for i in range(0, len(words), 300)]
        comma, out = self._encode([","])[0], []
        for run, got in zip(runs, self._encode([", ".join(x) + "," for x in runs]), strict=True):
            ends = np.flatnonzero(np.frombuffer(got, "<u4") == np.frombuffer(comma, "<u4")[0]) * 4 if len(comma) == 4 else ()
            if len(ends) == len(run):
                out += [got[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]
            else:  # a vocabulary in which a comma isn't one id
                out += self._encode(run)
        return out

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of units that begin with white space, end with none and hold no special token: the byte-level vocabulary cuts
        between them, so that they are encoded as one text and told apart by the bytes of its ids."""
        runs, out = [units[i : i + 300] for i in range(0, len(units), 300)], []
        for run, got in zip(runs, self._encode(["".join(x) for x in runs]), strict=True):
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, run)), np.int64, len(run)))
            ids = np.frombuffer(got, "<u4")
            done = np.cumsum(self.sizes[ids]) if len(ids) and ids.max() < len(self.sizes) else ends[:0]
            at = np.searchsorted(done, ends)
            if len(done) and done[-1] == ends[-1] and (done[at] == ends).all():
                cuts = (4 * at + 4).tolist()
                out += [got[a:b] for a, b in zip([0, *cuts], cuts)]
            else:  # a vocabulary whose pieces aren't the text's bytes
                out += self._encode(run)
        return out

    def _learn(self, units: list[str]) -> None:
        """The ids of new units. Letters and the punctuation after them are two words in both vocabularies."""
        known, whole, words, ended = self.known, [], [], []
        if len(self.tails) > 50_000:
            self.tails = {}
        if self.spaced:
            for x in units:
                last = x[-1:]
                if not last or last.isspace() or "<|" in x:
                    whole.append(x)
                elif last in _ENDING and (stem := x.rstrip(_ENDS))[-1:].isalpha():
                    known[stem]
                    ended.append((x, stem))
                else:
                    words.append(x)
            words += known.new
            known.update(zip(words, self._encode_units([x if x[:1] in _LED else " " + x for x in words]), strict=True))
            known.update(zip(whole, self._encode([x if x[:1] in _LED else " " + x for x in whole]), strict=True))
        else:
            for x in units:
                stem = x.rstrip(_ENDS)
                if not (stem.isalpha() and (stem.isascii() or stem.lower().isalpha())):
                    whole.append(x)
                elif len(stem) < len(x):
                    known[stem]
                    ended.append((x, stem))
                else:
                    words.append(x)
            words += known.new
            known.update(zip(words, self._encode_words(words), strict=True))
            known.update(zip(whole, self._encode(whole), strict=True))
        known.new.clear()
        tails = list({tail for x, stem in ended if (tail := x[len(stem) :]) not in self.tails})
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        tails = self.tails
        known.update([(x, known[stem] + tails[x[len(stem) :]]) for x, stem in ended])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Arrow numbers the distinct units of the texts, so that each is looked up once, and puts their ids in a row."""
        heads, rests, parts = zip(*map(self._prepared, texts), strict=True) if texts else ((), (), ())
        heads = self._encode(list(heads)) if self.spaced else [b""] * len(texts)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        units, many = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        if any(parts):  # texts that can't be cut at every space stand behind the others
            units = pa.concat_arrays([units, pa.array([x for own in parts for x in own], pa.large_string())])
        numbered = units.dictionary_encode()
        if len(self.known) > self.most:
            self.known = _Known(dict(self.known))
        if not self.spaced:
            self.known[""] = b""
        known, distinct = self.known, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        met = list(map(known.get, distinct))
        unmet = [x for x, got in zip(distinct, met, strict=True) if got is None]
        older = list(map(known.older.get, unmet))
        known.update([(x, got) for x, got in zip(unmet, older, strict=True) if got is not None])
        new = [x for x, got in zip(unmet, older, strict=True) if got is None]
        known.update(zip(new, new, strict=True))
        self._learn(new)
        each = pa.array([known[x] if got is None else got for x, got in zip(distinct, met, strict=True)], pa.large_binary())
        for x in new:
            if len(x) > self.longest:
                known.pop(x, None)
        whole = each.take(numbered.indices)
        ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        held, out = memoryview(whole.buffers()[2] or b""), []
        at, behind = 0, int(many.sum())
        for head, n, own in zip(heads, many.tolist(), parts, strict=True):
            a, at = at, at + n
            got = head + held[ends[a] : ends[at]]
            if own:
                got += held[ends[behind] : ends[behind + len(own)]]
                behind += len(own)
            out.append(got)
        return out


_made: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    most = 600_000 if spaced else 300_000  # vocabularies that keep case have more units
    return _made.get((path, spaced)) or _made.setdefault((path, spaced), Encoder(path, spaced, most))


def release() -> None:
    """Lets a worker that turns to other work give its encoders' memory back."""
    _made.clear()


def slices(texts: list[str | None], most: int = 4_000_000):
    """Index ranges whose texts together have about ``most`` characters, for bounded memory within a batch."""
    begin = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x or "") > most:
            yield begin, i
            begin, total = i, 0
        total += len(x or "")
    if begin < len(texts):
        yield begin, len(texts)
