"""Tokens of texts by way of their distinct white-space chunks.

The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's tokens are
those of its chunks, one after the other. A chunk of ASCII and plain Latin-1 letters falls further
apart into runs (letters, one digit, other signs), each of which is exactly one pre-token. Distinct
runs are encoded once for each worker and remembered up to a fixed number of entries.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

from weftline.llm.common import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII but ' and <, and Latin-1 letters: nothing that composes, contracts or is a special token.
PLAIN = re.compile(r"[\x00-&(-;=-\x7fÀ-ÖØ-öø-ÿ]*")
SIGNS = frozenset(bytes([b]) for b in b".,;:!?)")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def runs_of(chunk: bytes) -> list[str] | None:
    """The pre-tokens of a plain chunk, lowered; None for any other chunk."""
    if chunk.isalpha():  # of bytes: ASCII letters
        return [chunk.lower().decode()]
    if chunk[-1:] in SIGNS and chunk[:-1].isalpha():  # and a sign after them, as many have
        return [chunk[:-1].lower().decode(), chunk[-1:].decode()]
    text = chunk.decode()
    return RUNS.findall(text.lower()) if PLAIN.fullmatch(text) else None


class LibraryEncoder:
    """Ids by the tokenizers library."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(path))
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def runs(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of each run. Runs are encoded a thousand at a time, and taken apart at word ends."""
        return [x for ids, stops in self._many(runs) for x in np.split(ids, stops[:-1])]

    def run_bytes(self, runs: list[str]) -> list[bytes]:
        """As `runs`, in little-endian bytes of four for each id."""
        out: list[bytes] = []
        for ids, stops in self._many(runs):
            raw, ends = ids.tobytes(), (4 * stops).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def run_counts(self, runs: list[str]) -> list[int]:
        return [n for _, stops in self._many(runs) for n in np.diff(stops, prepend=0).tolist()]

    def _many(self, runs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        groups = [runs[i : i + 1000] for i in range(0, len(runs), 1000)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or len(ids) and stops[-1] != len(ids):  # not one word end for each
                each = self.chunks([r.encode() for r in group])
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            yield ids, stops

    def chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]


class ChunkMemo(dict):
    """chunk -> value. `of_runs` gives the values of runs, `make` turns ids into a value, `join` values of
    runs into that of their chunk. At most about `limit` chunks and as many runs stay."""

    def __init__(self, encoder, of_runs: Callable[[list[str]], list], make: Callable, join: Callable[[Iterable], object], limit: int = 400_000) -> None:
        self.encoder, self.of_runs, self.make, self.join, self.limit = encoder, of_runs, make, join, limit
        self.of_run: dict[str, object] = {}

    def forget(self) -> None:
        self.clear()
        self.of_run.clear()

    def learn(self, words: list[list[bytes]]) -> None:
        """After this every chunk of `words` has its value here."""
        self._bound()
        self._add(set(chain.from_iterable(words)).difference(self))

    def values(self, words: list[bytes]) -> list:
        """The value of each of `words`. Each is looked up once, and only new ones are compared with what is remembered:
        a set's difference from a kind of dict goes through all of the dict."""
        self._bound()
        found = list(map(self.get, words))
        missed = [i for i, v in enumerate(found) if v is None]
        self._add({words[i] for i in missed})
        for i in missed:
            found[i] = self[words[i]]
        return found

    def _bound(self) -> None:
        if len(self) > self.limit:
            self.clear()
        if len(self.of_run) > self.limit:
            self.of_run.clear()

    def _add(self, fresh: set[bytes]) -> None:
        apart = {c: runs_of(c) for c in fresh}
        new = list({r for rs in apart.values() if rs for r in rs}.difference(self.of_run))
        self.of_run.update(zip(new, self.of_runs(new)))
        get = self.of_run.__getitem__
        self.update((c, get(rs[0]) if len(rs) == 1 else self.join(map(get, rs))) for c, rs in apart.items() if rs)
        odd = [c for c, rs in apart.items() if not rs]
        self.update(zip(odd, map(self.make, self.encoder.chunks(odd))))


_MEMOS: dict[tuple, ChunkMemo] = {}


def memo(kind: str, build: Callable[[], ChunkMemo], *key) -> ChunkMemo:
    """One memo for each kind in a worker process, kept from task to task."""
    if (k := (kind, *key)) not in _MEMOS:
        _MEMOS[k] = build()
    claim(repr(k), _MEMOS[k].forget)
    return _MEMOS[k]
