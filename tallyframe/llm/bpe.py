"""BPE encoding by speculation and verification, and decoding.

For each new word, greedy longest match proposes tokens. A proposal is the word's BPE encoding if and
only if each adjacent pair of it is what BPE makes of the pair's own text; that is tested for all
pairs of a batch at once, by walking down the inner edges of both tokens' merge trees. Only words with
a failing pair are merged exactly. Words repeat, so a task keeps what it has encoded, up to a bound.

Texts of plain Latin letters are split into words by a pattern; all others by the tokenizer file's own
normaliser and splitter. Special tokens in a text become their ids, as the tokenizers library has it.

Odd cases: a null or empty text has no ids. Only doc_id and text are read, one output row per row.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallyframe.llm.common import map_batches

KEPT_WORDS = 200_000  # words that a worker remembers, twice
KEPT_CHUNKS = 250_000  # different chunks between white space that are split into words at once
LONG_WORD = 64  # characters; longer words are merged one by one
MERGED_TOGETHER = 20_000
TOGETHER_CHARS = 8_000_000  # of texts whose new words are encoded at once
_END = "\ue000"  # stands for the end of a word; no byte maps to it
_NEVER = np.int64(1) << 40
_LENGTH = 0xFF  # characters of a token that is proposed; a match is kept as id and length (8 bits)
# Texts of these characters alone are split by the pattern; the tests hold each of them against the library.
_PLAIN_CLASS = "[\t\n\r\x20-\x7e¡-įı-ſ–—‘-”…€]*"
_PLAIN = regex.compile(f"{_PLAIN_CLASS}+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE (fixed values)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printable)
    made = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [made[b] for b in range(256)]


def spread(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Groups of ``values``, which stand one after the other and have ``sizes``, in the order of ``which``, repeats included."""
    before, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return values[np.arange(n.sum()) + np.repeat(before - (np.cumsum(n) - n), n)]


class WordBpe:
    """A word-level BPE tokenizer from a file of the tokenizers library whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, library = content["model"], Tokenizer.from_file(path)
        suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.words = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.characters = _byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        size = max([*self.vocabulary.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.vocabulary.items(), *self.specials.items()]:
            self.tokens[i] = token

        # Merges: rank in the list, parts, and the pair that makes each token.
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        for k, (a, b) in enumerate(pairs):
            i = self.vocabulary[a + b]
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = self.vocabulary[a], self.vocabulary[b], k
        keys = np.array([self.vocabulary[a] << 20 | self.vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.rank_of = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}
        self.made = np.array([self.vocabulary[a + b] for a, b in pairs])

        own = np.flatnonzero(self.rank >= 0)
        good = np.ones(size, bool)
        good[own] = self.compatible(self.left[own], self.right[own], self.rank[own])
        for i in own[np.argsort(self.rank[own])]:
            good[i] &= good[self.left[i]] & good[self.right[i]]
        automaton = ahocorasick.Automaton()
        for token, i in self.vocabulary.items():
            if good[i]:
                text = token.removesuffix(suffix) + _END if token.endswith(suffix) and token != suffix else token
                if len(text) <= _LENGTH:
                    automaton.add_word(text, i << 8 | len(text))
        automaton.make_automaton()
        self.automaton = automaton
        self.codes = np.array([ord(c) for c in self.characters], "<u2")
        self.first = np.array([self.vocabulary[c] for c in self.characters])
        self.last = np.array([self.vocabulary[c + suffix] for c in self.characters])
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        self.known: dict[str, bytes] = {}  # words
        self.older: dict[str, bytes] = {}  # words of the generation before
        self.failed = 0  # words that needed exact merging, for tests and reports

    # -- verification -------------------------------------------------------------------------
    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of ``a`` and ``b`` comes before those that build both.

        ``until``: the rank at which both are merged with each other, if they are.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        used_a = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        used_b, good, rows = used_a.copy(), np.ones(len(a), bool), np.arange(len(a))
        while len(rows):
            across = self._pair_rank(a, b)
            bad = (across < used_a) & (across <= used_b) & (across < _NEVER)
            good[rows[bad]] = False
            made_a, made_b = self.rank[a], self.rank[b]
            go_on = ~bad & ((made_a >= 0) | (made_b >= 0))
            open_a = made_a > made_b  # of equal ranks the left one was merged first
            a, b, used_a, used_b = (
                np.where(open_a, self.right[a], a)[go_on],
                np.where(open_a, b, self.left[b])[go_on],
                np.where(open_a, made_a, used_a)[go_on],
                np.where(open_a, used_b, made_b)[go_on],
            )
            rows = rows[go_on]
        return good

    # -- exact merging ------------------------------------------------------------------------
    def merged(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of spelled words, given as their first ids one after the other and their numbers of ids.

        Step by step each word merges its first pair by rank, the leftmost of equals, until none is left.
        Words that are done leave; a step looks up only the pairs at the places of the last merges.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(ids), _NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._pair_rank(ids[inside], ids[inside + 1])
        done = []
        while len(word):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            still = least < _NEVER
            if not still.all():
                stay = np.repeat(still, lengths)
                done.append((word[~stay], ids[~stay]))
                word, ids, rank, lengths, least = word[stay], ids[stay], rank[stay], lengths[still], least[still]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
            ids[hit] = self.made[rank[hit]]
            rank[hit] = rank[hit + 1]  # whether a pair follows
            keep = np.ones(len(word), bool)
            keep[hit + 1] = False
            hit -= np.arange(len(hit))
            word, ids, rank = word[keep], ids[keep], rank[keep]
            right = hit[(hit + 1 < len(word)) & (word[np.minimum(hit + 1, len(word) - 1)] == word[hit])]
            rank[right] = self._pair_rank(ids[right], ids[right + 1])
            left = hit[(hit > 0) & (word[hit - 1] == word[hit])] - 1
            rank[left] = self._pair_rank(ids[left], ids[left + 1])
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(sizes))

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one word with a heap, in time in proportion to n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find, heap = self.rank_of.get, []

        def offer(k: int, r: int) -> None:
            if (rank := find(ids[k] << 20 | ids[r])) is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[r]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if ids[k] != a or (r := after[k]) >= n or ids[r] != b:
                continue
            ids[k], ids[r], after[k] = int(self.made[rank]), -1, after[r]
            if after[k] < n:
                before[after[k]] = k
                offer(k, after[k])
            if before[k] >= 0:
                offer(before[k], k)
        return [i for i in ids if i >= 0]

    # -- words --------------------------------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        lengths, spelled = self._spelled(words)
        flat, sizes = self._proposals(lengths, spelled)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(sizes[sizes > 0]) - 1] = False  # a word's last token has no pair
        at = np.flatnonzero(inside)
        pairs, where = np.unique(flat[at] << 20 | flat[at + 1] if len(at) else np.empty(0, np.int64), return_inverse=True)
        wrong = ~self.compatible(pairs >> 20, pairs & 0xFFFFF)[where]
        good = sizes > 0
        good[np.repeat(np.arange(len(words)), sizes)[at[wrong]]] = False
        self.failed += int(len(words) - good.sum())

        short, long = np.flatnonzero(~good & (lengths <= LONG_WORD)), np.flatnonzero(~good & (lengths > LONG_WORD))
        for at in range(0, len(short), MERGED_TOGETHER):
            part = short[at : at + MERGED_TOGETHER]
            self._keep([words[k] for k in part.tolist()], *self.merged(self._single(lengths, spelled, part), lengths[part]))
        for k in long.tolist():
            ids = self.merged_long(self._single(lengths, spelled, np.array([k])).tolist())
            self.known[words[k]] = np.array(ids, "<u4").tobytes()
        self._keep([w for w, fine in zip(words, good.tolist(), strict=True) if fine], flat[np.repeat(good, sizes)], sizes[good])

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each word has, and the bytes of all, one word after the other."""
        made = pa.array(words, pa.large_binary())
        lengths = np.diff(np.frombuffer(made.buffers()[1], np.int64, len(words) + 1))
        return lengths, np.frombuffer(made.buffers()[2] or b"", np.uint8, lengths.sum())

    def _single(self, lengths: np.ndarray, spelled: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The ids of single bytes that spell some of the words."""
        taken, ends = spread(spelled, lengths, which), np.cumsum(lengths[which]) - 1
        ids = self.first[taken]
        ids[ends] = self.last[taken[ends]]
        return ids

    def _proposals(self, lengths: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words, one after the other, and how many each word has; 0 if it is not covered.

        Words go through the automaton as one text: no token goes on behind the end of a word, so each starts afresh.
        """
        count, places = len(lengths), np.arange(len(spelled)) + np.repeat(np.arange(len(lengths)), lengths)
        codes = np.full(len(spelled) + count, ord(_END), "<u2")
        codes[places] = self.codes[spelled]
        matches = self.automaton.iter_long(codes.tobytes().decode("utf-16-le"))
        at, found = np.fromiter(chain.from_iterable(matches), np.int64).reshape(-1, 2).T
        word = np.repeat(np.arange(count), lengths + 1)[at]
        covered = np.bincount(word, found & _LENGTH, count) == lengths + 1
        return (found >> 8)[covered[word]], np.bincount(word, minlength=count) * covered

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.known.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=False))

    # -- texts --------------------------------------------------------------------------------
    def _remember(self, words: Iterable[str]) -> None:
        if len(self.known) > KEPT_WORDS:  # a new generation; what is met again moves to it
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [w for w in words if w and w not in known]
        known[""] = b""  # behind the last word of a chunk
        if older:
            known.update([(w, older[w]) for w in new if w in older])
            new = [w for w in new if w not in older]
        if new:
            self.learn(new)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has. What is not a word alone is split by the pattern."""
        single = pc.utf8_is_alpha(chunks)
        rest = pc.replace_substring_regex(chunks.filter(pc.invert(single)), self.words, r"\0 ")
        parts = pc.ascii_split_whitespace(pc.replace_with_mask(chunks, pc.invert(single), rest))
        found = parts.flatten().dictionary_encode()
        words, of = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        self._remember(words)
        raw = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat = spread(np.frombuffer(b"".join(raw), "<u4"), sizes, of)
        ends = np.concatenate(([0], np.cumsum(sizes[of])))[parts.offsets.to_numpy()]
        return flat, np.diff(ends)

    def _other(self, text: str) -> bytes:
        """Normalised and split as the tokenizer file says."""
        byte_of = self.byte_of
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        words = [bytes([byte_of[c] for c in word]).decode() for word, _ in found]
        self._remember(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER_CHARS:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def _together(self, texts: list[str]) -> list[bytes]:
        """Encode some texts, learning the new words of all of them at once.

        Meanwhile Python's search for cycles is off: there are none, and it would walk over all kept words again and again.
        """
        searching = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if searching:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        split, segments = [], []  # of each text its parts: bytes that are done, or the place of a segment
        for text in texts:
            parts, at = [], 0
            for cut in self.special.finditer(text) if "<" in text else ():
                parts += [len(segments), self.raw[self.specials[cut[0]]]]
                segments.append(text[at : cut.start()])
                at = cut.end()
            split.append([*parts, len(segments)])
            segments.append(text[at:] if at else text)
        plain = pc.match_substring_regex(pa.array(segments, pa.large_string()), f"\\A{_PLAIN_CLASS}\\z").to_pylist()
        made = iter(self._plain_ids([s.lower() for s, fine in zip(segments, plain, strict=True) if fine]))
        done = [next(made) if fine else self._other(s) for s, fine in zip(segments, plain, strict=True)]
        return [b"".join([p if isinstance(p, bytes) else done[p] for p in parts]) for parts in split]

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts. White space always separates words, so each different chunk between it is encoded once."""
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        found = chunks.flatten().dictionary_encode()
        several = range(0, len(found.dictionary), KEPT_CHUNKS)
        made = [self._chunk_ids(found.dictionary.slice(k, KEPT_CHUNKS).cast(pa.string())) for k in several]
        if not made:
            return [b""] * len(texts)
        ids, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
        of = found.indices.to_numpy()
        flat = spread(ids, sizes, of).tobytes()
        ends = (4 * np.concatenate(([0], np.cumsum(sizes[of])))[chunks.offsets.to_numpy()]).tolist()
        return [flat[a:b] for a, b in pairwise(ends)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: tokens, special ones too, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer per worker process and file."""
    return WordBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = pa.array(list(bpe.encode_all(batch.column("text").to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary"
    return map_batches(docs.select("doc_id", "text"), encode, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the text they decode to."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        numerals = np.array([str(i) for i in range(len(bpe.tokens))], object)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for raw in bpe.encode_all(batch.column("text").to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(numerals[ids].tolist()).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), digest, schema)
