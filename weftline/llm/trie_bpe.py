"""BPE encoding over a trie of distinct words.

Byte-pair encodings can be built from left to right: the encoding of a prefix ends in the one token
that (a) is a suffix of the prefix and (b) stands next to the last token of what remains, i.e. encoding
the two together gives just those two. A prefix therefore needs one remembered state, its last
token, and every word that shares the prefix shares the state. Words are walked in sorted order, which
is the depth-first order of their trie; the stack holds the states of the current path, and stepping to
the next word keeps the states of the common prefix.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import chunks
from weftline.llm.common import pieces


def _byte_signs() -> dict[int, str]:
    """The usual printable sign for each byte of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words with the merges of a vocabulary file; only its normaliser and pre-tokenizer are
    taken from the library, for chunks that are not plain."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        path = chunks.tokenizer_path(path)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.signs = _byte_signs()
        self.parts = {i: self._signs_of(t) for t, i in self.vocab.items()}
        alone = {t: i for t, i in self.vocab.items() if self.merge(self.parts[i]) == [i]}
        self.inner = {t: i for t, i in alone.items() if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)]: i for t, i in alone.items() if t.endswith(self.end)}
        self.inner_most, self.last_most = (max(map(len, d)) for d in (self.inner, self.last))
        self.fits: dict[int, bool] = {}

    def _signs_of(self, token: str) -> list[int]:
        """The single-sign tokens that a token is made of."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end]]
        return [self.vocab[c] for c in token]

    def merge(self, ids: list[int]) -> list[int]:
        """Plain merging by rank, leftmost first; used for pairs of tokens only."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def adjacent(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (found := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[key] = self.merge(self.parts[a] + self.parts[b]) == [a, b]
        return found

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words given in the vocabulary's byte signs; `words` in ascending order."""
        inner, last, fits, adjacent = self.inner, self.last, self.fits, self.adjacent
        n_inner, n_last = self.inner_most, self.last_most
        token, size = [0], [0]  # by depth: last token of the prefix, and its length
        before, out = "", []
        for w in words:
            n = len(w)
            if not n:
                out.append(np.array([], dtype="<u4"))
                continue
            k, most = 0, min(len(before), n - 1, len(token) - 1)
            while k < most and before[k] == w[k]:
                k += 1
            del token[k + 1 :], size[k + 1 :]
            for i in range(k + 1, n):  # new nodes of the trie
                for j in range(max(0, i - n_inner), i):
                    t = inner.get(w[j:i])
                    if t is not None:
                        if not j:
                            break
                        p = token[j]
                        ok = fits.get(p << 20 | t)
                        if ok or ok is None and adjacent(p, t):
                            break
                else:
                    raise ValueError(f"no token ends {w[:i]!r}")
                token.append(t)
                size.append(i - j)
            for j in range(max(0, n - n_last), n):  # the leaf: tokens that end a word
                t = last.get(w[j:n])
                if t is not None and (not j or adjacent(token[j], t)):
                    break
            else:
                raise ValueError(f"no token ends the word {w!r}")
            ids = [t]
            while j:
                ids.append(token[j])
                j -= size[j]
            out.append(np.array(ids[::-1], dtype="<u4"))
            before = w
        return out

    def runs(self, runs: list[str]) -> list[np.ndarray]:
        as_signs = [r.encode().decode("latin-1").translate(self.signs) for r in runs]
        order = sorted(range(len(runs)), key=as_signs.__getitem__)
        found = self.words([as_signs[i] for i in order])
        out: list[np.ndarray] = [None] * len(runs)  # type: ignore[list-item]
        for i, ids in zip(order, found):
            out[i] = ids
        return out

    def chunks(self, odd: list[bytes]) -> list[np.ndarray]:
        """Chunks with special strings, apostrophes or letters beyond Latin-1."""
        out = []
        for c in odd:
            ids: list[np.ndarray] = []
            for part in self._apart(c.decode()):
                if part in self.special:
                    ids.append(np.array([self.special[part]], dtype="<u4"))
                elif part:
                    pre = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
                    for p in pre:
                        ids += self.words([p])
            out.append(np.concatenate(ids) if ids else np.array([], dtype="<u4"))
        return out

    def _apart(self, text: str) -> list[str]:
        """`text` cut at special strings, leftmost first."""
        out = []
        while text:
            at = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=None)
            if at is None:
                return [*out, text]
            out += [text[: at[0]], at[1]]
            text = text[at[0] + len(at[1]) :]
        return out


def _build(path: str | None) -> chunks.ChunkMemo:
    enc = TrieEncoder(path)

    def make(ids: np.ndarray) -> tuple[int, str, str]:
        ids = ids.tolist()
        return len(ids), " ".join(map(str, ids)), " ".join(map(enc.text.__getitem__, ids))

    def join(parts) -> tuple[int, str, str]:
        n, ids, texts = zip(*parts)
        return sum(n), " ".join(ids), " ".join(texts)

    return chunks.ChunkMemo(enc, lambda runs: list(map(make, enc.runs(runs))), make, join, 300_000)


def encode_digest(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row.

    ids_sha256 is over the decimal ids joined by a space, decoded_sha256 over the text that decoding the
    ids gives (this vocabulary has no decoder: token texts joined by a space). `keep_ids` adds the ids
    themselves. A null or blank text has no tokens and the digests of the empty string. Repeated rows
    and null ids each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunks.memo("trie", lambda: _build(tokenizer), tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, ids_sha, text_sha, ids_out = [], [], [], []
            for a, b in pieces(texts):
                words = [(t or b"").split() for t in texts[a:b]]
                memo.learn(words)
                get = memo.__getitem__
                for ws in words:
                    # every chunk has a token but a chunk of other white space, which is left out
                    found = [v for v in map(get, ws) if v[0]]
                    ids = " ".join([v[1] for v in found])
                    n.append(sum([v[0] for v in found]))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join([v[2] for v in found]).encode()).hexdigest())
                    if keep_ids:
                        ids_out.append(list(map(int, ids.split())))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
