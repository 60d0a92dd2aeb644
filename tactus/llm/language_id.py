"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded amount of labelled text gives the longest match at any place. A text is
parsed greedily into phrases, each the longest that occurs in the language's text; few phrases mean
few bits. The language that needs the fewest phrases, in proportion to the text and to the bits that name a phrase, wins.

Letters are bytes: A-Z are lowered, runs of other than letters become one mark. Texts are parsed in pieces of PIECE letters, so
all pieces of many texts advance together, one table look-up each, whatever the lengths of the texts; each piece's start is then
parsed again from where the piece before ended, so phrases are those of the whole text. Any number of languages
is scored in blocks of BLOCK_LANGUAGES, one table at a time, keeping the best rate so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import held_out, map_texts, row_blocks, text_bytes

#: Letters of reference text for each language, and rows that they are taken from, at most.
REFERENCE_LETTERS = 24_000
REFERENCE_ROWS = 60
#: Places of a row, from its start to its end, that its letters are taken from.
PLACES = 4
#: Languages whose tables are in memory together.
BLOCK_LANGUAGES = 8
#: Letters of a text that are parsed in step with others, and letters after which a parse that began elsewhere is in the same state, if not, the text is parsed letter by letter.
PIECE, MEET = 256, 64
BLOCK_BYTES = 1 << 20
#: Text that is held while the blocks of languages pass, if there are several.
HELD_BYTES = 16 << 20
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"


def _letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, offsets): A-Z lowered, bytes from 0x80 as they are, each run of others one mark 0; none before the first letter."""
    code = np.zeros(256, np.uint8)
    code[0x61:0x7B] = np.arange(0x61, 0x7B)
    code[0x41:0x5B] = np.arange(0x61, 0x7B)
    code[0x80:] = np.arange(0x80, 0x100)
    x = code[data]
    keep = x != 0
    mark = ~keep
    mark[1:] &= keep[:-1]
    if len(x):
        mark[at[:-1][at[:-1] < len(x)]] = False
    keep |= mark
    offsets = np.concatenate([[0], np.cumsum(keep)])[at]
    return x[keep], offsets


def suffix_automaton(letters: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a letter sequence: its number of states, and from, letter and to of its arcs; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in letters:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    came = np.repeat(np.arange(len(step), dtype=np.int32), [len(arcs) for arcs in step])
    by = np.fromiter((c for arcs in step for c in arcs), np.uint8, len(came))
    to = np.fromiter((t for arcs in step for t in arcs.values()), np.int32, len(came))
    return len(step), came, by, to


@dataclass
class LanguageModel:
    """What is broadcast of one block of languages: arcs, a tenth of the table or less."""

    languages: list[str]
    letter: np.ndarray  # byte -> column; 0 the mark, 1 a byte that no reference has
    width: int
    arcs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # of each language, see suffix_automaton
    bits: np.ndarray  # bits that name a phrase of each language

    def opened(self) -> Parser:
        width = self.width
        states = [n for n, *_ in self.arcs]
        table = np.empty((sum(states), width), np.int32 if sum(states) * width < 1 << 28 else np.int64)
        starts, base = [], 0
        for n, came, by, to in self.arcs:
            start = base * width
            # no arc: the phrase ends, and the letter starts the next one, or is a phrase alone if the language lacks it
            anew = np.full(width, start << 2 | 2, np.int64)
            first = np.full(width, start << 2 | 1, np.int64)
            root = came == 0
            anew[by[root]] = (to[root].astype(np.int64) + base) * width << 2 | 1
            part = table[base : base + n]
            part[:] = anew
            part[0] = first
            part[came, by] = (to.astype(np.int64) + base) * width << 2
            starts.append(start)
            base += n
        return Parser(self.letter, table.ravel(), np.array(starts, table.dtype), self.bits)


@dataclass
class Parser:
    letter: np.ndarray
    table: np.ndarray  # (row of state) + column -> row of next state * 4 + phrases that end
    start: np.ndarray  # row of each language's first state
    bits: np.ndarray

    def phrases(self, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text by each language: (texts, languages)."""
        n, k = len(offsets) - 1, len(self.start)
        size = np.diff(offsets)
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = offsets[:-1][owner] + nth * PIECE
        left = np.minimum(offsets[1:][owner] - first, PIECE)
        o = np.argsort(-left, kind="stable")  # the pieces that go on are always the first ones
        place = np.empty_like(o)
        place[o] = np.arange(len(o))
        before = np.where(nth[o] > 0, place[o - 1], -1)  # where the piece before is
        first, left, owner = first[o], left[o], owner[o]
        column = self.letter[letters].astype(np.int32)
        state = np.repeat(self.start[:, None], len(owner), axis=1)
        count = np.zeros((k, len(owner)), np.int32)
        going = np.searchsorted(-left, -np.arange(PIECE), "left")  # pieces longer than t
        longest = int(left[0]) if len(left) else 0
        seen = []
        for t in range(longest):
            m = int(going[t])
            got = self.table[state[:, :m] + column[first[:m] + t]]
            count[:, :m] += got & 3
            state[:, :m] = got >> 2
            if t < MEET:
                seen.append((state[:, :m].copy(), count[:, :m].copy()))
        # each piece was parsed as if a phrase began there; the parse that comes from the piece before soon is in the same state
        open_ = np.repeat(before[None, :] >= 0, k, axis=0)
        now, more = state[:, before], np.zeros((k, len(owner)), np.int32)
        for t in range(min(MEET, longest)):
            m = int(going[t])
            got = self.table[now[:, :m] + column[first[:m] + t]]
            more[:, :m] += got & 3
            now[:, :m] = got >> 2
            was, counted = seen[t]
            met = open_[:, :m] & (now[:, :m] == was)
            count[:, :m] += np.where(met, more[:, :m] - counted, 0)
            open_[:, :m] &= ~met
        ended = open_ & (left <= MEET)  # a short last piece
        count, state = np.where(ended, more, count), np.where(ended, now, state)
        last = np.ones(len(owner), bool)
        last[before[before >= 0]] = False
        count += (state != self.start[:, None]) & last  # the phrase that the end of the text cuts off
        out = np.stack([np.bincount(owner, c, minlength=n) for c in count], axis=1)
        langs, apart = np.nonzero(open_ & ~ended)
        for lang, text in set(zip(langs.tolist(), owner[apart].tolist(), strict=True)):
            out[text, lang] = self.walk(column[offsets[text] : offsets[text + 1]], lang)
        return out

    def walk(self, columns: np.ndarray, lang: int) -> int:
        """Phrases of one text, letter by letter."""
        state = start = int(self.start[lang])
        count = 0
        for c in columns.tolist():
            got = int(self.table[state + c])
            count += got & 3
            state = got >> 2
        return count + (state != start)


def train(reference: dict[str, bytes]) -> LanguageModel:
    """reference: letters (see _letters) of each language's text, the preferred languages first."""
    languages = list(reference)  # ties go to the first
    seen = np.zeros(256, bool)
    for text in reference.values():
        seen[np.frombuffer(text, np.uint8)] = True
    seen[0] = False
    used = np.flatnonzero(seen)
    letter = np.ones(256, np.uint8)
    letter[0] = 0
    letter[used] = np.arange(2, len(used) + 2)
    width = len(used) + 2
    arcs = [suffix_automaton(letter[np.frombuffer(reference[name], np.uint8)].tobytes()) for name in languages]
    bits = np.array([np.log2(len(reference[x]) + 2) for x in languages])
    return LanguageModel(languages, letter, width, arcs, bits)


def _has_letter(column: pa.Array) -> np.ndarray:
    """Texts with a letter of any script."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))


def _spread(x: bytes, n: int) -> bytes:
    """At most n letters of x, from PLACES places between its start and its end, with marks between them."""
    if len(x) <= n or n < 2 * PLACES:
        return x[:n]
    size = (n - PLACES + 1) // PLACES
    return b"\0".join(x[a : a + size] for a in np.linspace(0, len(x) - size, PLACES).astype(int).tolist())


def _fair(parts: list[bytes], letters: int) -> list[bytes]:
    """The same share of each, as large as `letters` in all allow; what short ones leave goes to the others."""
    left, share = letters, letters
    for i, size in enumerate(sorted(map(len, parts))):
        share = left // (len(parts) - i)
        if size > share:
            break
        left -= size
    else:
        return parts
    return [_spread(p, share) for p in parts]


def _reference_letters(most: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                letters, at = _letters(*text_bytes(b.column("text")))
                got = [_spread(letters[x:y].tobytes(), most) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("row"), pa.array(got, pa.binary())], names=["lang", "row", "letters"])

    return take


def fit_languages(docs: DataFrame, letters: int = REFERENCE_LETTERS, rows: int = REFERENCE_ROWS) -> dict[str, bytes]:
    """Letters of every lang that is not null in the training fold, the most frequent lang first.

    A lang gives at most `rows` rows (by the least hash of doc_id, or of the text where doc_id is null) and `letters` letters, a fair
    share of each row, from places spread over it. Repeated ids of a lang count once. Rows bound the sample, not languages: the driver
    holds at most `rows` ids and 2 * `letters` letters of each.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long"))).alias("row")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)).select("lang", key, "text")
    spark = docs.sparkSession
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return {UNDETERMINED: b"a"}
    # rows above a hash that leaves several times too many need not move; a lang that is left with too few ids repeats them, and is looked at whole
    enough = 4 * rows + 64
    cuts = {name: (1 << 64) * enough // n - (1 << 63) if n > enough else (1 << 63) - 1 for name, n in counts.items()}
    chosen: list[tuple[str, int]] = []
    while cuts:
        asked = F.broadcast(spark.createDataFrame(list(cuts.items()), "lang string, cut long"))
        ids = known.join(asked, "lang").where("row <= cut").select("lang", "row").distinct()
        first = ids.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("row"))).where(F.col("_n") <= rows).select("lang", "row")
        got: dict[str, list[int]] = {name: [] for name in cuts}
        for r in first.collect():
            got[r["lang"]].append(r["row"])
        again = [name for name, found in got.items() if len(found) < rows and cuts[name] < (1 << 63) - 1]
        chosen += [(name, row) for name, found in got.items() if name not in again for row in found]
        cuts = dict.fromkeys(again, (1 << 63) - 1)
    texts = known.join(F.broadcast(spark.createDataFrame(chosen, "lang string, row long")), ["lang", "row"])
    share = max(1, 2 * letters // rows)
    parts: dict[str, list[bytes]] = {name: [] for name in counts}
    found = texts.mapInArrow(_reference_letters(share), "lang string, row long, letters binary").groupBy("lang", "row").agg(F.min("letters").alias("letters"))
    for r in sorted(found.collect(), key=lambda r: r["row"]):
        if r["letters"]:
            parts[r["lang"]].append(bytes(r["letters"]))
    return {name: b"\0".join(_fair(p, letters)) for name, p in parts.items() if p} or {UNDETERMINED: b"a"}


def _parsers(packed: list) -> Iterator[Parser]:
    """The parser of each block of languages; of several, one is in memory at a time."""
    for p in packed:
        parser = p.value.opened()
        if len(packed) > 1:
            p.__dict__.pop("_value", None)  # what a worker has read stays in its broadcast otherwise
        yield parser


def identify(docs: DataFrame, reference: dict[str, bytes], keep: list[str] | None = None, block_languages: int = BLOCK_LANGUAGES) -> DataFrame:
    """One row per row of docs (doc_id, text): the columns named in keep (doc_id by default), held_out, lang_pred, score.

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter. score: the winner's
    share of the odds, from the bits a letter that each language needs. Ties go to the language with more training rows. Repeated
    rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    languages = list(reference)
    blocks = [languages[i : i + block_languages] for i in range(0, len(languages), block_languages)]
    packed = [docs.sparkSession.sparkContext.broadcast(train({x: reference[x] for x in b})) for b in blocks]  # each bounded by block_languages and REFERENCE_LETTERS

    def block():
        names = np.array([*languages, UNDETERMINED])
        only = list(_parsers(packed)) if len(packed) == 1 else None

        def judge(texts: pa.Array) -> dict:
            n = len(texts)
            rows = pa.RecordBatch.from_arrays([texts], names=["text"])
            parts = [_letters(*text_bytes(b.column(0))) for b in row_blocks(rows, "text", BLOCK_BYTES)]
            ends = np.cumsum([0, *(len(at) - 1 for _, at in parts)])
            best, found, odds, seen = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n), 0
            for parser in only or _parsers(packed):
                for (letters, at), a, b in zip(parts, ends[:-1], ends[1:], strict=True):
                    size = np.maximum(np.diff(at), 1)
                    rate = parser.phrases(letters, at) * parser.bits / size[:, None]  # bits a letter
                    least = rate.min(axis=1)
                    found[a:b] = np.where(least < best[a:b], seen + rate.argmin(axis=1), found[a:b])
                    least = np.minimum(least, best[a:b])
                    odds[a:b] = odds[a:b] * np.exp2(-4 * (best[a:b] - least)) + np.exp2(-4 * (rate - least[:, None])).sum(axis=1)
                    best[a:b] = least
                seen += len(parser.start)
            ok = _has_letter(texts)
            lang = names[np.where(ok, found, len(languages))]
            return {"lang_pred": pa.array(lang.tolist(), pa.string()), "score": np.where(ok, 1 / np.maximum(odds, 1), 0.0)}

        return judge

    out = map_texts(docs, keep, block, "lang_pred string, score double", BLOCK_BYTES if len(packed) == 1 else HELD_BYTES)
    return out.select(*keep, held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
