"""Shared plumbing of the training-data operators: scratch tables in the cluster's shared
folder, names that clash with no column, and the word-cached tokenizer."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..scratch import Scratch, components, shared_dir

__all__ = ["Scratch", "components", "shared_dir"]


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores as no column (in any case of letters) has."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns freed memory to the system at the end of a task. Python workers live on from
    task to task, and allocators keep what they once held."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- tokenizing


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII punctuation that never combines with a letter and holds no apostrophe.
TAIL = ".,!?;:%#*$&|"


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies spell every byte as a printable character: itself, or the next
    free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


class _Words(dict):
    """Ids by word. A word not held comes from the generation before, or is learnt."""

    __slots__ = ("learn", "before")

    def __init__(self, learn, before: dict[str, bytes]):
        self.learn, self.before = learn, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids


class CachedEncoder:
    """Encodes whole texts with the tokenizers library through a bounded cache of words.

    The vocabulary's pre-tokenizer drops white space and never joins characters across it, so
    the ids of a text are those of its white-space-separated chunks in turn. A chunk's ids are
    made by the library once: letters in normal form, with or without trailing ASCII
    punctuation, go to the library's model straight away, any other chunk through the whole
    library. A text is lower-cased beforehand unless it holds a letter whose lower case
    depends on its place, or grows. Texts with the separators 0x1C-0x1F, which only Python
    counts as white space, go to the library whole.

    The cache has two generations of ``most`` words, and what a text adds: a full one becomes
    the generation before, whose words come back as they are met, so common words stay."""

    def __init__(self, path: str, most: int = 300_000):
        import re
        import unicodedata

        self.tokenizer, self.most = _tokenizer(path), most
        self.model, self.spell = self.tokenizer.model, _byte_chars()
        self.known = _Words(self._learn, {})
        self.odd = re.compile("[\x1c-\x1f]")
        self.is_normalized = unicodedata.is_normalized

    def _library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        import array

        spelled = "".join(map(self.spell.__getitem__, word.encode()))
        return array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, word: str) -> bytes:
        body = word.rstrip(TAIL)
        if not (body.isalpha() and self.is_normalized("NFC", body) and body.lower() == body and "\u03c3" not in body):
            return self._library(word)
        tail = word[len(body) :]
        return self.known[body] + self.known[tail] if tail else self._letters(body)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.odd.search(t):
                out.append(self._library(t))
                continue
            if len(self.known) > self.most:
                self.known = _Words(self._learn, dict(self.known))
            low = t.lower()
            words = (t if len(low) != len(t) or "\u03a3" in t or "<|" in t else low).split()
            out.append(b"".join(map(self.known.__getitem__, words)))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One per Python worker."""
    return CachedEncoder(path)


def text_slices(batches, most_chars: int = 2_000_000):
    """Cuts Arrow batches (id, text) into lists of rows holding at most so many characters
    (or one text), so that memory follows a slice and not a batch."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            if ids and size + len(t) > most_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
        if ids:
            yield ids, texts


def default_tokenizer() -> str:
    """Path of the public word-level vocabulary; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
