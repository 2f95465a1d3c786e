"""BPE encoding and decoding with a pair occurrence index.

All words that a batch brings for the first time are merged together: each pair of neighbouring symbols maps to all its
positions, the active pair of the lowest rank is applied to its whole list, and only the lists of the neighbours that
changed are updated. Words are independent and a merged symbol's own pairs rank later than the merge that made it, so
this gives each word what merging it alone would give."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_map, read, worker_table

CACHE_WORDS = 150_000  # words whose ids a Python worker remembers in each of two generations, about
SLICE_CHARS = 2_000_000  # characters worked on at a time
ODD_BLANKS = regex.compile("[\x1c-\x1f]")  # blanks to str.split(), not to the pattern


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    named = {b: chr(b) for b in plain}
    rest = iter(range(0x100, 0x200))
    return [named[b] if b in named else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file with word ends, byte-level symbols and a split pattern."""

    def __init__(self, spec: str) -> None:
        held = json.loads(spec)
        model = held["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[x] for x in symbols], np.int64)
        self.last = np.array([self.vocab[x + end] for x in symbols], np.int64)
        # merges by rank: the pair and what it becomes; a pair's code (two ids of 16 bits) gives its rank
        self.left = [self.vocab[a] for a, _ in model["merges"]]
        self.right = [self.vocab[b] for _, b in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        ranks = {a << 16 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.codes = np.array([*sorted(ranks), 1 << 40], np.int64)
        self.code_rank = np.array([*(ranks[c] for c in sorted(ranks)), -1], np.int64)
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        pattern = next(x["pattern"]["Regex"] for x in held["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.blanks = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.past: dict[str, tuple[bytes, str]] = {}

    # -- merging ---------------------------------------------------------------------------------------------------
    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids end; all words are merged together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        first = self.inner[buf]
        first[ends - 1] = self.last[buf[ends - 1]]
        nxt, prv = np.arange(1, len(buf) + 1), np.arange(-1, len(buf) - 1)
        nxt[ends - 1] = prv[ends[:-1]] = -1
        if len(buf):
            prv[0] = -1
        # the index: ranks of the pairs at hand, with the positions of each in ascending order
        codes = (first[:-1] << 16) | first[1:]
        at = np.searchsorted(self.codes, codes)
        there = np.flatnonzero((self.codes[at] == codes) & (nxt[:-1] >= 0))
        rank = self.code_rank[at[there]]
        order = np.argsort(rank, kind="stable")
        active, starts = np.unique(rank[order], return_index=True)
        lists = np.split(there[order], starts[1:])
        places = {r: p.tolist() for r, p in zip(active.tolist(), lists, strict=False)}
        active = list(places)
        while active:
            r = heapq.heappop(active)
            ps = np.array(places.pop(r), np.int64)
            if len(ps) > 1:
                ps = np.unique(ps)
            for i, p in self.apply(r, ps, first, nxt, prv):
                if p in places:
                    places[p].append(i)
                else:
                    places[p] = [i]
                    heapq.heappush(active, p)
        ids = first
        alive = ids >= 0
        return ids[alive], np.cumsum(alive)[ends - 1]

    def apply(self, r: int, ps: np.ndarray, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray):
        """Merge the pair of rank ``r`` at those of the positions ``ps`` that still hold it; (position, rank) of the
        pairs that come to be."""
        left, right, made = self.left[r], self.right[r], self.made[r]
        js = nxt[ps]
        held = (sym[ps] == left) & (js >= 0) & (sym[js] == right)
        ps, js = ps[held], js[held]
        if left == right and len(ps) > 1 and (held := np.isin(ps, js)).any():  # a run of one symbol: every other pair
            taken, keep = set(), []
            for i, j in zip(ps.tolist(), js.tolist(), strict=True):
                keep.append(i not in taken)
                if keep[-1]:
                    taken.add(j)
            ps, js = ps[keep], js[keep]
        ks, hs = nxt[js], prv[ps]
        sym[ps], sym[js], nxt[ps] = made, -1, ks
        right_on, left_on = ks >= 0, hs >= 0
        prv[ks[right_on]] = ps[right_on]
        at = np.concatenate([ps[right_on], hs[left_on]])
        codes = (sym[at] << 16) | sym[nxt[at]]
        where = np.searchsorted(self.codes, codes)
        there = self.codes[where] == codes
        return zip(at[there].tolist(), self.code_rank[where[there]].tolist(), strict=True)

    # -- texts -----------------------------------------------------------------------------------------------------
    def normal(self, text: str) -> str:
        """NFC and lower case character by character (no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def runs(self, text: str) -> list[str | int]:
        """Stretches without blanks, and the ids of added tokens, in order."""
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
        out: list[str | int] = []
        for p in parts:
            if p in self.added:
                out.append(self.added[p])
            elif p:
                s = self.normal(p)
                out.extend(x for x in self.blanks.split(s) if x) if ODD_BLANKS.search(s) else out.extend(s.split())
        return out

    def learn(self, runs: Iterable[str]) -> None:
        """Put the ids and decoded form of unknown runs into memory."""
        runs = list(runs)
        split = [[r] if r.isalpha() else self.pieces.findall(r) for r in runs]
        words = list({w for ws in split for w in ws})
        ids, ends = self.merge(words)
        raw, names, of, i = ids.astype("<u4").tobytes(), list(map(self.token.__getitem__, ids.tolist())), {}, 0
        for w, j in zip(words, ends.tolist(), strict=True):
            of[w] = (raw[4 * i : 4 * j], " ".join(names[i:j]))
            i = j
        for r, ws in zip(runs, split, strict=True):
            got = [of[w] for w in ws]
            self.known[r] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks: the file names no decoder. Unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [self.runs(t) for t in texts]
        wanted: set = set()
        for rs in split:
            wanted.update(rs)
        for t in wanted & self.token.keys():  # ids of added tokens
            self.known[t] = (t.to_bytes(4, "little"), self.token[t])
        if len(self.known) > CACHE_WORDS:  # words that the next generation doesn't meet again are forgotten with the last
            self.known, self.past = {}, self.known
        new = wanted - self.known.keys()
        self.known.update((t, self.past[t]) for t in new & self.past.keys())
        self.learn(new - self.past.keys())
        known = self.known
        out = []
        for rs in split:
            got = [known[r] for r in rs]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def _worker(spec: str) -> WordBpe:
    """One encoder for each Python worker and file."""
    return worker_table(("bpe", hash(spec)), lambda: WordBpe(spec))


def slices(lengths: list[int | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters, by the texts' lengths; a longer text stands alone."""
    at = size = 0
    for i, length in enumerate(lengths):
        n = (length or 0) + 64
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, len(lengths)


def encode_bpe(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` (binary: token ids as little-endian unsigned 32-bit integers) and ``decoded`` to each row.

    ``path`` is a tokenizer file on the driver; its text (a few MB, whatever the input) is broadcast. A null or empty
    text has no ids and decodes to an empty text; repeated rows each get their own result; an empty table stays empty;
    columns named ids or decoded are replaced, all others stay. Strings of added tokens become their single ids. Rows
    never leave their partition: no shuffle."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(spec.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            for i, j in slices(pc.utf8_length(texts).to_pylist()):
                got = bpe.encode_all([t or "" for t in texts.slice(i, j - i).to_pylist()])
                more = [pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in b.columns] + more, names=[*b.schema.names, "ids", "decoded"]
                )

    return arrow_map(docs, encode, "ids binary, decoded string", drop=("ids", "decoded"))


def decode_bpe(docs: DataFrame, path: str) -> DataFrame:
    """Replace ``decoded`` by the text of column ``ids`` (as encode_bpe gives it); null or empty ids give an empty text,
    ids that the file doesn't know are left out. Repeated rows fare alike, other columns stay, an empty table stays empty."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(ids):
        bpe = _worker(spec.value)
        return ids.map(lambda x: bpe.decode(np.frombuffer(x or b"", "<u4").tolist()))

    return docs.withColumn("decoded", decoded("ids"))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Token ids and decoded form of every whole text of ``documents``; cases as encode_bpe() says."""
    out = encode_bpe(read(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
