"""Byte-level BPE through a two-tier map-side lookup.

Text is cut into pre-tokens, whose encodings don't depend on what stands around them. The first tier is a compact hash
table that is broadcast once: for counts, the token lengths of the corpus's most frequent words (token_counts.py); for
ids, the vocabulary's own entries. Either is bounded, whatever the corpus. What misses it is encoded once and kept in the
worker's caches, the second tier. No pre-token is shuffled. Misses are merged by the rank of each pair, in native code,
where the file's ids follow its merges, which gives what the file's own library gives; else by that library.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import regex

from quire.llm.common import map_batches

#: Unicode white space as the library's pattern takes it, the pattern's parts, the special text.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Entries of a generation of a worker's caches of words and of pre-tokens; longer ones than CACHE_CHARS aren't kept.
CACHE_WORDS, CACHE_PIECES, CACHE_CHARS = 150_000, 50_000, 64
#: Letters below this character are letters in every version of Unicode; marks that may end a word.
LETTERS_BELOW, ENDS = "\u0250", frozenset(",.;:!?")
#: Characters of a text that are cut at once.
AT_ONCE = 1_000_000


def checked(path: str) -> dict:
    """The file's model; an error unless it cuts texts as this module does."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    cut = held["pre_tokenizer"] or {}
    special = [(t["content"], t["id"], t["single_word"], t["lstrip"], t["rstrip"]) for t in held["added_tokens"]]
    if held["model"]["type"] != "BPE" or held["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True) or special != [(SPECIAL, SPECIAL_ID, False, False, False)]:
        raise ValueError(f"{path} isn't a byte-level BPE with the special text {SPECIAL}")
    return held["model"]


def frequent(path: str) -> dict[str, bytes]:
    """Vocabulary entries that are a pre-token each, with their ids as little-endian unsigned 32-bit numbers."""
    from tokenizers import Tokenizer

    checked(path)
    library, pattern = Tokenizer.from_file(path), regex.compile(PRE_TOKEN)
    texts = [library.decode([i]) for i in range(library.get_vocab_size())]
    texts = [x for x in texts if "\ufffd" not in x and pattern.findall(x) == [x]]
    return {x: packed_ids(e.ids) for x, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)}


def frequent_table(spark, path: str) -> dict[str, bytes]:
    """frequent(), worked out in a task: the library's own tables take 100 MB, which the driver needn't hold."""

    def run(batch):
        held = frequent(path)
        yield {"text": list(held), "ids": list(held.values())}

    rows = map_batches(spark.range(1, numPartitions=1), run, "text string, ids binary").toArrow()
    return dict(zip(rows.column("text").to_pylist(), rows.column("ids").to_pylist(), strict=True))


def lengths(path: str, words: list[str]) -> dict[str, int]:
    """The number of tokens of each word, a space before it included."""
    from tokenizers import Tokenizer

    checked(path)
    found = Tokenizer.from_file(path).encode_batch([f" {w}" for w in words], add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, found, strict=True)}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes with their ids, if ids follow the order of merging; else None.

    Then merging by id, which needs no look at merges, gives what the library's merging gives.
    """
    model = checked(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    vocabulary = model["vocab"]
    first = len(vocabulary) - len(merged)
    if any(vocabulary.get(m) != first + i for i, m in enumerate(merged)) or any(c not in letters for t in vocabulary for c in t):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}


class Kept(dict):
    """What has been looked up, kept for a while in two generations: once the younger is full it becomes the older, so what is used again stays."""

    def __init__(self, find, most: int) -> None:
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def pair_merger(path: str):
    """Ids of a pre-token."""
    ranks = byte_ranks(path)
    if ranks is not None:
        import tiktoken

        return tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda piece: library.encode(piece, add_special_tokens=False).ids


class Encoder:
    """Cuts texts without the pattern where that gives the same pre-tokens, and looks the parts up.

    A pre-token has a space at its start only, and other white space not at all, except for runs of white space. So a
    text falls apart before each space and around each line feed that stand alone. What is all letters is one pre-token,
    a mark after it another one; the pattern cuts the rest. value(ids) is what is wanted of ids, add what makes one of many; pieces and words hold the first tier: values of pre-tokens, and of words after a space.
    """

    def __init__(self, path: str, value, add, pieces: dict | None = None, words: dict | None = None) -> None:
        merge, pattern = pair_merger(path), regex.compile(PRE_TOKEN)
        pieces, words = pieces or {}, words or {}

        def piece(text: str):
            found = pieces.get(text)
            return value(merge(text)) if found is None else found

        self.lookup = Kept(piece, CACHE_PIECES)
        self.value, self.add = value, add

        def plain(chunk: str) -> bool:
            return chunk.isalpha() and (chunk.isascii() or max(chunk) < LETTERS_BELOW)

        def kept(before: str, words: dict) -> Kept:
            def find(chunk: str):
                found = words.get(chunk)
                if found is not None:
                    return found
                if plain(chunk):
                    return piece(before + chunk)
                if chunk[-1:] in ENDS and plain(chunk[:-1]):
                    return add((own[chunk[:-1]], self.lookup[chunk[-1]]))
                return add(map(self.lookup.__getitem__, pattern.findall(before + chunk)))

            own = Kept(find, CACHE_WORDS)
            return own

        self.bare, self.spaced = kept("", {}), kept(" ", words)
        self.run = re.compile(f"[{WHITE}]{{2}}").search
        alone = re.compile(f" (?<=[^{WHITE}] )(?=[^{WHITE}])")
        self.apart, self.next_alone = alone.split, alone.search
        self.around = "".join(chr(c) for c in range(0x3001) if regex.match(f"[{WHITE}]", chr(c)))

    def parts(self, text: str) -> Iterator:
        """Values of the text, in order, in parts."""
        for i, section in enumerate(text.split(SPECIAL)):
            if i:
                yield self.value([SPECIAL_ID])
            while len(section) > AT_ONCE and (space := self.next_alone(section, AT_ONCE)):
                yield self.block(section[: space.start()])
                section = section[space.start() :]
            yield self.block(section)

    def block(self, text: str):
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        body = text.lstrip(self.around)
        if self.run(body):
            chunks = self.apart(text)
            return self.add([bare(chunks[0]), *map(spaced, chunks[1:])])
        out: list = []
        feed, head = bare("\n"), text[: len(text) - len(body)]
        for line in body.split("\n"):
            first, *others = line.split(" ")
            out.append(bare(head + first))
            out.extend(map(spaced, others))
            out.append(feed)
            head = ""
        return self.add(out[:-1])


def id_encoder(path: str, table: dict[str, bytes]) -> Encoder:
    """Packed ids. table: frequent()."""
    return Encoder(path, packed_ids, b"".join, pieces=table)


def count_encoder(path: str, table: dict[str, int]) -> Encoder:
    """Numbers of tokens. table: lengths()."""
    return Encoder(path, len, sum, words=table)


_encoders: dict[tuple, tuple] = {}


def on_workers(spark, make, path: str, table: dict):
    """A function that gives a worker's encoder, make(path, table); the table is broadcast. The encoder lives as long as the worker, so later batches find a warm cache."""
    held, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def encoder() -> Encoder:
        if _encoders.get(path, ("",))[0] != name:
            _encoders[path] = (name, make(path, held.value))
        return _encoders[path][1]

    return encoder
