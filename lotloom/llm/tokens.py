"""Token ids of whole batches by a vocabulary file of the tokenizers library.

Neither vocabulary used here has a token over a blank and what stands before it, so a text is cut
at blanks, every distinct piece of a batch is encoded once by the library, and the ids of all
occurrences are gathered by numpy. Texts in which white space precedes a blank that more white
space or the end follows are encoded as a whole by the library, since there the cut would not
agree. The result is the library's own for every text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import vectext

#: Distinct pieces a worker remembers, across the batches and tasks it runs.
REMEMBERED = 400_000


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Marks that both vocabularies cut off from the letters before them (the apostrophe is none), and
# words of letters that every version of Unicode has.
MARKS = ".,!;:?%#$&*|\"()/-"
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0239]+$"


class Encoder:
    """Encodes arrays of texts; ``drops_blanks`` tells that white space gives no ids at all."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.drops_blanks = not self._alone(" \n\t ")
        self.lowers = self._alone("ABC\u00c9") == self._alone("abc\u00e9")
        self.size = self.library.get_vocab_size()
        self.known: dict[str, bytes] = {"": b""}
        #: bytes of text that each id stands for; both vocabularies spell a byte as one character
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, k in self.library.get_vocab().items():
            self.bytes_of[k] = len(token.removesuffix("</w>"))

    def _alone(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces not met before, many to a call of the library where that gives the same ids.

        A piece without white space, but for a blank at its front where blanks count, can stand
        behind any other such piece: the cut is at its blank. Which ids are whose follows from
        the bytes they stand for; a call in which those do not fit the pieces is done one by one.
        """
        out: dict[str, bytes] = {}
        blank = " " if self.drops_blanks else ""
        if self.drops_blanks:
            joined = [p for p in pieces if p.isalnum() or len(p.split()) == 1 and p == p.strip()]
        else:
            joined = [p for p in pieces if p[:1] == " " and (p[1:].isalnum() or len(p.split()) == 1 and p[1:] == p.strip())]
        calls = [joined[at : at + 200] for at in range(0, len(joined), 200)]
        for some, made in zip(calls, self.library.encode_batch([blank.join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in (blank.join(some).lower().split(" ") if self.lowers and self.drops_blanks else some)])
            reached = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[cut] == ends).all():
                data, at = ids.tobytes(), 0
                for p, end in zip(some, ((cut + 1) * 4).tolist(), strict=True):
                    out[p] = data[at:end]
                    at = end
        alone = [p for p in pieces if p not in out]
        for piece, made in zip(alone, self.library.encode_batch(alone, add_special_tokens=False), strict=True):
            out[piece] = np.array(made.ids, "<u4").tobytes()
        return [out[p] for p in pieces]

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        unknown = list(dict.fromkeys(p for p in pieces if p not in known))
        if len(known) + len(unknown) > REMEMBERED:
            known = self.known = {"": b""} | {p: known[p] for p in pieces if p in known}
        known.update(zip(unknown, self._fresh(unknown), strict=True))
        return [known[p] for p in pieces]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, number of ids of each text)."""
        texts = vectext.filled(texts)
        count = len(texts)
        if self.drops_blanks:
            whole = np.zeros(count, bool)
            split = pc.ascii_split_whitespace(texts)
        else:
            whole = pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x85\p{Z}] (?:[\s\x0b\x1c-\x1f\x85\p{Z}]|$)|\s\z").to_numpy(zero_copy_only=False)
            split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # a piece is a word and the marks behind it, or one thing as it stands
        word = pc.utf8_rtrim(names, characters=MARKS)
        plain = pc.match_substring_regex(word, LETTERS)
        word = pc.if_else(plain, pc.utf8_lower(word) if self.lowers else word, names)
        marked = np.flatnonzero((pc.binary_length(names).to_numpy(zero_copy_only=False) > pc.binary_length(word).to_numpy(zero_copy_only=False)) & plain.to_numpy(zero_copy_only=False))
        words = word.dictionary_encode()
        begin = "" if self.drops_blanks else " "  # every piece but a text's first has a blank before it
        pieces = [begin + w for w in words.dictionary.to_pylist()]
        front = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        back = np.full(len(names), len(pieces), np.int64)
        pieces.append("")
        tails: dict[str, int] = {}
        for k, name in zip(marked.tolist(), names.take(pa.array(marked)).to_pylist(), strict=True):
            back[k] = tails.setdefault(name[len(name.rstrip(MARKS)) :], len(pieces) + len(tails))
        pieces += tails
        if not self.drops_blanks:
            first = (np.cumsum(lengths) - lengths).astype(np.int64)
            heads, place = np.unique(codes[first], return_inverse=True)
            codes[first] = len(front) + place
            front = np.concatenate([front, len(pieces) + np.arange(len(heads))])
            back = np.concatenate([back, np.full(len(heads), len(words.dictionary), np.int64)])
            pieces += names.take(pa.array(heads)).to_pylist()
        used = np.zeros(len(pieces), bool)
        used[front[codes]] = True
        used[back[codes]] = True
        parts = self._looked_up([p if u else "" for p, u in zip(pieces, used.tolist(), strict=True)])
        if whole.any():
            rows = np.flatnonzero(whole)  # each of these has the one empty piece so far
            codes[first[rows]] = len(front) + np.arange(len(rows))
            front = np.concatenate([front, len(parts) + np.arange(len(rows))])
            back = np.concatenate([back, np.full(len(rows), len(words.dictionary), np.int64)])
            parts += [np.array(self._alone(texts[row].as_py()), "<u4").tobytes() for row in rows.tolist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.cumsum(sizes) - sizes
        # word and marks are put together once for each distinct piece, then pieces for each place
        both = np.empty(2 * len(front), np.int64)
        both[0::2], both[1::2] = front, back
        table = vectext.gather(np.frombuffer(b"".join(parts), "<u4"), begins[both], sizes[both])
        size = sizes[front] + sizes[back]
        here = size[codes]
        ids = vectext.gather(table, (np.cumsum(size) - size)[codes], here)
        ends = np.concatenate([[0], np.cumsum(here)])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[bounds[1:]] - ends[bounds[:-1]]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` appended to each text's ids; (ids, where each text begins and the last ends)."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    out = np.full(bounds[-1], end, "<u4")
    keep = np.ones(bounds[-1], bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds
