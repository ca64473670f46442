"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

Per text, the tokens of B are intervals of bytes in a static index (sorted starts and ends). Each token of A stabs it by two bisections, which
give the list of B tokens it overlaps; every gap between two B tokens of one list is spanned. Gaps that no token of A spans are the
borders of groups. A group's last tokens end together and are linked.

Neither tokenizer joins what a single space parts (the first splits before a space, no piece of the second has a space behind another
character), so texts are cut before each single space that stands between others, and what lies between, a chunk, is aligned once per
task and kept, up to a bound. The index is made over many new chunks at a time. Where a vocabulary has pieces that cross spaces,
texts stay whole.

How often two ids are linked in the whole corpus is counted by the block exchange (``exchange``): a block of documents asks parts about its
distinct id pairs, dealt by the id of B, so that one part sees all pairs of that id and knows the most frequent. A pair that all documents
hold costs one entry a block.

Edge cases: null and empty texts, texts that aren't valid UTF-8, and texts which one of the tokenizers doesn't give back byte for byte have no
tokens: zeros and an empty digest, and they count for nothing. Special tokens' strings are plain text. Repeated rows are counted and reported each, null ids too;
ties for the most frequent pair all count as best; an empty table gives an empty result; further columns are passed over. A text's tokens are
held together: memory grows with the longest text, by some 60 bytes a token.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import exchange as X
from notelake.session import dropped, parts_for, tidied, written

CUT = re.compile(r"(?<=[^ ]) (?=\S)")
MOST_CHUNKS, MOST_CHARS = 400_000, 16 << 20
ID_BITS = 20  # of an id in a pair
OUTPUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
OUTPUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def borders(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The places of B tokens behind which a group ends. Both token rows cover the same bytes, without empty tokens."""
    starts_a, starts_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
    first = np.searchsorted(ends_b, starts_a, "right")  # the first B token that ends behind the start
    last = np.searchsorted(starts_b, ends_a, "left") - 1  # the last that starts before the end
    spanned = np.zeros(len(ends_b) + 1, np.int64)
    np.add.at(spanned, first, 1)
    np.add.at(spanned, last, -1)
    return np.flatnonzero(np.cumsum(spanned)[: len(ends_b)] == 0)  # the gap behind B token j is spanned by lists from at most j to beyond it


class Aligner:
    """Both tokenizers and the chunks that this task has aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS or not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("vocabularies of 1 to 2 ** 20 entries without empty ones are asked for")
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # an id with what may follow it: inside a group, at the end of its A ids, at the end of its B ids
        named = [*(b"%d," % i for i in range(len(pieces))), *(b"%d;" % i for i in range(len(pieces))), *(b"%d," % i for i in range(len(self.bytes_a))), *(b"%d|" % i for i in range(len(self.bytes_a)))]
        self.named, self.shift = np.array(named, object), np.array([0, len(pieces), 2 * len(pieces), 2 * len(pieces) + len(self.bytes_a)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[bytes] = []  # each chunk's groups as text
        self.sizes = np.empty((0, 4), np.int64)  # tokens of A, of B, groups, 1 if it can't be aligned
        self.flat, self.at, self.chars = np.empty(0, np.int64), np.zeros(1, np.int64), 0  # links, one for each group

    def learn(self, chunks: list[str]) -> None:
        """Align distinct new chunks, by one index over all of them."""
        raw = [b" " + c.encode() for c in chunks]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        ids_b = self.b.encode(chunks, num_threads=1)
        size = np.array([len(r) for r in raw], np.int64)

        def same(ids: list, of: list[bytes], lens: np.ndarray) -> np.ndarray:
            n = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate([np.array(i, np.int64) for i in ids]) if n.sum() else np.empty(0, np.int64)
            total = np.bincount(np.repeat(np.arange(len(ids)), n), lens[flat], len(ids)).astype(np.int64)
            if (total == size).all() and b"".join([of[i] for i in flat.tolist()]) == b"".join(raw):
                return np.ones(len(ids), bool)
            return np.array([b"".join([of[i] for i in own]) == r for own, r in zip(ids, raw)], bool)

        good = same(ids_a, self.bytes_a, self.len_a) & same(ids_b, self.bytes_b, self.len_b)
        sizes = np.zeros((len(chunks), 4), np.int64)
        sizes[:, 3] = ~good
        take = np.flatnonzero(good).tolist()
        names, links = [b""] * len(chunks), np.empty(0, np.int64)
        if take:
            n_a, n_b = (np.array([len(ids[i]) for i in take], np.int64) for ids in (ids_a, ids_b))
            a, b = (np.concatenate([np.array(ids[i], np.int64) for i in take]) for ids in (ids_a, ids_b))
            ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            last_b = borders(ends_a, ends_b)
            last_a = np.searchsorted(ends_a, ends_b[last_b])
            links = b[last_b] << ID_BITS | a[last_a]
            text_b, text_a = b.copy(), a + self.shift[2]
            text_b[last_b] += self.shift[1]
            text_a[last_a] += len(self.bytes_a)
            group_b = np.searchsorted(last_b, np.arange(len(b)))
            group_a = np.searchsorted(last_a, np.arange(len(a)))
            every = np.empty(len(a) + len(b), np.int64)
            every[np.arange(len(a)) + np.r_[0, last_b[:-1] + 1][group_a]] = text_a  # behind all B tokens of the groups before
            every[np.arange(len(b)) + (last_a + 1)[group_b]] = text_b  # behind all A tokens of the groups up to its own
            said = self.named[every].tolist()
            stop = np.cumsum(n_a + n_b).tolist()
            for i, s, e in zip(take, [0, *stop], stop):
                names[i] = b"".join(said[s:e])
            groups = np.diff(np.r_[0, np.searchsorted(last_b, np.cumsum(n_b))])
            sizes[take, 0], sizes[take, 1], sizes[take, 2] = n_a, n_b, groups
        self.known.update(zip(chunks, range(len(self.names), len(self.names) + len(chunks))))
        self.names += names
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, links])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes[:, 2])])
        self.chars += sum(map(len, chunks))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups (a row each) and the digest; and, text by text, the links as codes of (B id, A id), with their number for each text."""
        if len(self.known) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.forget()
        cut: list[list[str]] = []
        for t in texts:
            try:
                s = t.decode()
            except UnicodeDecodeError:
                s = ""
            cut.append((CUT.split(s) if self.cuts else [s]) if s else [])
        new = list({c for own in cut for c in own if c not in self.known})
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        get, names = self.known.__getitem__, self.names
        numbers = [np.fromiter(map(get, own), np.int64, len(own)) for own in cut]
        out, digests = np.zeros((len(texts), 3), np.int64), [""] * len(texts)
        for i, own in enumerate(numbers):
            total = self.sizes[own].sum(axis=0)
            if len(own) and not total[3]:
                out[i] = total[:3]
                digests[i] = hashlib.sha256(b"".join([names[k] for k in own.tolist()])[:-1]).hexdigest()
            else:
                numbers[i] = own[:0]
        every = np.concatenate([np.empty(0, np.int64), *numbers])
        n = self.sizes[every, 2]
        stop = np.cumsum(n)
        links = self.flat[np.repeat(self.at[every] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        return out, digests, links, out[:, 2]


KNOWN: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This task's aligner (functions travel by value, so each task has globals of its own); what it keeps depends on the chunks alone."""
    if (path_a, path_b) not in KNOWN:
        KNOWN[path_a, path_b] = Aligner(path_a, path_b)
    return KNOWN[path_a, path_b]


def pair_keys(codes: np.ndarray, parts: int) -> np.ndarray:
    """Part keys of pair codes: the part by the id of B, the code itself below."""
    b = (codes >> ID_BITS).astype(np.uint64)
    low = np.uint64(2 * ID_BITS)
    return X.part_keys(X.mixed(b + np.uint64(1)) >> low << low | codes.astype(np.uint64), parts)


def align(documents: DataFrame, paths: tuple[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    own, parts = paths or tokenizer_paths(), parts or parts_for(documents, 32)

    def ask(ids, ties, texts):
        sizes, digests, links, n = aligner(*own).read(texts)
        codes, of = X.coded(links)
        keys = pair_keys(codes, parts)
        order = np.argsort(keys)
        times = np.bincount(of, minlength=len(codes))
        kept = X.frame(X.pack(ids), X.pack(X.is_null(ids, ties)), *(X.pack(sizes[:, k]) for k in range(3)), X.squeezed("\n".join(digests).encode()), X.pack(n), X.pack(of), X.pack(order.astype(np.int32)))
        return [(-1, kept), *X.dealt(keys[order], parts, ((X.pack, times[order]),))]

    def answer(part, got):
        """Twice the corpus-wide count of each pair asked for, plus one if no pair of its B id has more."""
        frames = [X.unframe(d) for _, d in got]
        distinct, of, _, ends = X.merged([X.unpack_keys(f[0]) for f in frames])
        total = np.bincount(of, np.concatenate([X.unpack(f[1], np.int64) for f in frames]), len(distinct)).astype(np.int64)
        b = distinct >> np.uint64(ID_BITS)
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        most = np.repeat(np.maximum.reduceat(total, start), np.diff(np.r_[start, len(b)]))
        out = (total * 2 + (total == most))[of]
        return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(out, ends[:-1]))]

    asks, kept = X.saved(X.asked(documents, ask, ordered=False), "align-asked")
    counts = tidied(written(X.answered(asks, parts, answer), "align-counts"))
    dropped(asks)

    def finish(state, got):
        ids, none, *sizes, digests, n, of, order = X.unframe(state)
        ids, none, n, of, order = (X.unpack(x, t) for x, t in ((ids, np.int64), (none, np.bool_), (n, np.int64), (of, np.int32), (order, np.int32)))
        found = np.empty(len(order), np.int64)
        found[order] = np.concatenate([np.empty(0, np.int64), *(X.unpack(d, np.int64) for _, d in got)])
        doc, each = np.repeat(np.arange(len(n)), n), found[of]
        sums = [np.zeros(len(n), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc, each & 1)
        np.add.at(sums[1], doc, each >> 1)
        said = [pa.array(X.unpack(x, np.int64)) for x in sizes]
        return pa.Table.from_arrays([pa.array(ids, mask=none), *said, pa.array(n), *map(pa.array, sums), pa.array(X.expanded(digests).decode().split("\n"), pa.string())], schema=OUTPUT)

    return X.by_block(kept, counts, finish, OUTPUT_DDL)
