"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LIMIT = 512
#: Entries that the cache of counted words holds before it is emptied, and the longest word that enters it.
CACHE = 1_000_000
LONGEST = 48
#: The pattern by which byte-level BPE vocabularies of this kind split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts without any but these characters are split here; for others the library's own splitter is asked, as Unicode
#: versions may differ on what is a letter or a space.
STRANGE = r"[^\t\n\r\x20-\x7e -ɏ‐-‧‰-⁞€]"

_counters: dict[str, Counter] = {}


class Counter:
    """Counts the tokens that tokenizers gives for a byte-level BPE file, without special tokens added."""

    def __init__(self, path: str, proven: tuple[frozenset[str], frozenset[str]] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.split = regex.compile(PATTERN).findall
        self.strange = re.compile(STRANGE).search
        # added tokens are found in the raw text before anything else; each is one token
        self.specials = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.specials)).split if self.specials else None
        self.letters = byte_letters()
        self.whole, self.whole_mapped = self.proven() if proven is None else proven
        self.spaced: dict[str, int] = {}

    def proven(self) -> tuple[frozenset[str], frozenset[str]]:
        """The vocabulary strings that the merges build into one token: as text, those that are also a pre-token of their own by
        PATTERN; and all of them in the vocabulary's letters, for pre-tokens that the library has cut itself.

        The driver proves them once and sends the sets to the workers.
        """
        from_letters = {ord(c): b for b, c in enumerate(self.letters)}
        out, mapped_out = set(), set()
        for mapped in self.lib.get_vocab(with_added_tokens=False):
            if len(self.model.tokenize(mapped)) != 1:
                continue
            mapped_out.add(mapped)
            try:
                text = bytes(from_letters[ord(c)] for c in mapped).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split(text) == [text]:
                out.add(text)
        return frozenset(out), frozenset(mapped_out)

    def merged(self, piece: str) -> int:
        letters = self.letters
        return len(self.model.tokenize("".join([letters[b] for b in piece.encode()])))

    def pieces(self, pieces: list[str]) -> int:
        whole = self.whole
        return sum([1 if p in whole else self.merged(p) for p in pieces])

    def stretches(self, words: list[str]) -> int:
        """Tokens of words that each follow one space."""
        try:
            return sum(map(self.spaced.__getitem__, words))
        except KeyError:
            pass
        spaced, total = self.spaced, 0
        if len(spaced) > CACHE:
            self.spaced = spaced = {}
        for w in words:
            n = spaced.get(w)
            if n is None:
                n = self.pieces(self.split(" " + w))
                if len(w) <= LONGEST:
                    spaced[w] = n
            total += n
        return total

    def segment(self, text: str) -> int:
        if not text:
            return 0
        if not self.strange(text):
            if "  " in text:
                return self.pieces(self.split(text))
            # before a lone space a pre-token always ends, so the stretches between such spaces count on their own
            first, *rest = text.split(" ")
            return self.pieces(self.split(first)) + self.stretches(rest)
        whole, tokenize = self.whole_mapped, self.model.tokenize
        return sum([1 if mapped in whole else len(tokenize(mapped)) for mapped, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)])

    def __call__(self, text: str) -> int:
        if self.cut and any(s in text for s in self.specials):
            parts = self.cut(text)
            return len(parts) - 1 + sum(map(self.segment, parts))
        return self.segment(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest count up from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def counter(path: str, proven=None) -> Counter:
    """The process's counter of a file; proven: a broadcast of the sets that the driver has proven."""
    if path not in _counters:
        _counters[path] = Counter(path, None if proven is None else proven.value)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; null text is empty (0 tokens).

    path: a tokenizers JSON file of byte-level BPE, present on every executor. Rows are independent of each
    other; repeated rows are counted each, very long texts whole; an empty table gives an empty result. Every pre-token is looked
    up in the proven set first, whatever script the text is in.
    """
    text = text_of(docs)
    slim = docs.select(docs["doc_id"], F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    own = counter(path)
    proven = docs.sparkSession.sparkContext.broadcast((own.whole, own.whole_mapped))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(path, proven)
        for batch in batches:
            n = [count_one(t.as_py()) for t in batch.column(2)]
            tokens = pa.array(n, pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
