"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens (words without punctuation, A-Z lower-cased) in which numbers, names and units are
typed placeholders:

* Numbers hold a digit (decimals are kept) or are number words; a number word after a number belongs to it.
* Units are unit words after a number.
* Names are words with a capital first letter, in any script and wherever they stand, so that neither a line's nor a
  sentence's start makes a difference. Function words are none, nor is a noun after a German article. Several names in
  a row are one.

Windows of WINDOW tokens are hashed; the documents' windows are hash-joined with the benchmark's, the templates compared
literally, and the slots checked: equal numbers, names and units of the item have to be equal in the document, too, and
different names different. So a question with other numbers or names is caught, one with the same words in other roles
isn't.

How rare a window is decides what it can prove: a literal word counts log2(words / its uses) bits over all items,
function words FUNCTION_BITS at most. A window with LEAST_BITS in its literals matches with any consistent slots; one
that only has them together with SLOT_BITS for each slot has to agree in the slots' values.

A bitmap of fixed size holds the benchmark's window hashes and keeps other windows from leaving the scan; the joins
after it are exact, and neither side has to fit into memory. Items that share a window are one row of the join.

Defined results: items with fewer than WINDOW tokens are matched as a whole, if they have LEAST_BITS at all; null or
empty texts match nothing; repeated rows are told by their id only, and their windows count once; an empty benchmark or
table gives no rows; a null id stays null; other columns are ignored. Texts are taken in slices of about 1 MB; a longer
one is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import drop_rows, in_sketch, membership_sketch, spread_join, written
from tessera.llm._words import _LOWER, _SEP, gram_hashes, mix64, slices, text_buffer, word_hashes, word_spans

WINDOW = 10
LEAST_BITS = 24.0
SLOT_BITS = 6.0
FUNCTION_BITS = 3.0
SKETCH_BITS = 24
#: Words that name a unit when they follow a number: English, German, French, Spanish (fixed values).
UNITS = (
    "mm cm dm m km g mg kg t lb lbs oz ml cl l ft mph kmh h min s ms kb mb gb watt watts volt volts "
    "inch inches foot feet yard yards mile miles meter meters metre metres liter liters litre litres gallon gallons gram grams kilogram kilograms "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds percent degree degrees "
    "meilen stunde stunden sekunde sekunden minuten tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad kilometer zentimeter gramm kilogramm "
    "mètre mètres kilomètre kilomètres litres gramme grammes kilogramme kilogrammes heure heures seconde secondes jour jours semaine semaines mois ans année années pour-cent "
    "metro metros kilómetro kilómetros litro litros gramo gramos kilogramo kilogramos hora horas segundo segundos minuto minutos día días semana semanas meses año años"
).split()
#: Words that are numbers, in the same languages (fixed values; those that are articles as well are left out).
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille "
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
#: Function words, by language (fixed values).
FUNCTION_WORDS = {
    "en": "a an the and or but if then else when while as at by for from in into of off on onto out over to up with without about after before than that this these those "
    "i he she it we you they his her its our your their him them me us who whom whose which what where why how is are was were be been has have had do does did "
    "will would can could may might must shall should not no there here each every all some any many much more most both so such only also let given find",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als wie bei für von aus in im auf an am zu zum zur mit ohne nach vor über um "
    "ich er sie es wir ihr ist sind war waren hat haben wird werden kann nicht kein keine was wer wo warum jede jeder jedes",
    "fr": "le la les un une du de et ou mais si quand comme dans sur sous avec sans pour par il elle ils elles nous vous je ce cette ces qui que quoi où est sont était",
    "es": "el los las una unos unas y o pero cuando como en con sin para por él ella ellos es son era fue cada cuál qué quién",
}
FUNCTION = " ".join(FUNCTION_WORDS.values()).split()
GERMAN_ARTICLES = "der die das den dem des ein eine einen einem einer eines kein keine keinen".split()
PLACEHOLDERS = {1: "<number>", 2: "<name>", 3: "<unit>"}
_KEPT = np.zeros(256, bool)
_KEPT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?()[]{}|")] = True
#: Hyphens and slashes part words, too.
_PARTS = _SEP.copy()
_PARTS[list(b"-/")] = True
_PLACE_HASH = mix64(np.arange(101, 105, dtype=np.uint64))
WINDOW_FIELDS = "h long, pos int, template string, slots array<string>"


@cache
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    """Sorted hashes of words, and of those that begin with a letter beyond A-Z as they stand at a sentence's start."""
    raw = [w.encode() for w in dict.fromkeys([*words, *(w.capitalize() for w in words if not w[0].isascii())])]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


@cache
def _capitals() -> np.ndarray:
    return np.array([chr(i).isupper() or chr(i).istitle() for i in range(0xD800)])


def _among(hashes: np.ndarray, words: list[str]) -> np.ndarray:
    known = _hashes(tuple(words))
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _capital(raw: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character at each place is a capital."""
    b0, b1, b2 = (raw[np.minimum(ks + i, len(raw) - 1)].astype(np.int64) for i in range(3))
    code = np.where(b0 < 0xC0, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F))
    return (b0 < 0xF0) & _capitals()[np.minimum(code, 0xD7FF)] & (code < 0xD800)


class Tokens:
    """The tokens of a batch: ``hashes`` (placeholders have fixed ones), ``kinds`` (0: literal), ``rows``, texts."""

    def __init__(self, column: pa.Array):
        buf, offs = text_buffer(column)
        s, e, rows = word_spans(buf, offs, _PARTS)
        kept = _KEPT[buf]
        if len(buf) > 2:
            # Quotation marks, dashes and dots of the block of general punctuation are no letters.
            mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80))
            kept[mark], kept[mark + 1], kept[mark + 2] = False, False, False
            digit = (buf >= 48) & (buf <= 57)
            kept[1:-1] |= ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
        ks, ke = upto[s], upto[e]
        some = ke > ks
        ks, ke, rows = ks[some], ke[some], rows[some]
        raw = buf[kept]
        self.raw, self.low = raw, _LOWER[raw]
        self.hashes = word_hashes(self.low, ks, ke)
        self.ks, self.ke, self.rows, self.kinds = ks, ke, rows, np.zeros(len(ks), np.uint8)
        if not len(ks):
            return
        digits = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw >= 48) & (raw <= 57))])
        spelled = _among(self.hashes, NUMBERS)
        number = (digits[ke] > digits[ks]) | spelled
        follows = np.zeros(len(ks), bool)
        follows[1:] = rows[1:] == rows[:-1]
        # A mark between two words parts them; where it stands in the text is told by the bytes before.
        marks = np.cumsum(_BREAK[buf] & ~kept)[np.flatnonzero(kept)[ks]]
        close = follows.copy()
        close[1:] &= marks[1:] == marks[:-1]
        after = lambda x: np.concatenate([np.zeros(1, bool), x[:-1]]) & follows
        unit = after(number) & ~number & _among(self.hashes, UNITS)
        name = _capital(raw, ks) & ~number & ~unit & ~_among(self.hashes, FUNCTION) & ~after(_among(self.hashes, GERMAN_ARTICLES))
        kinds = np.select([number, unit, name], [1, 3, 2], 0).astype(np.uint8)
        joined = close & ((name & after(name)) | (spelled & after(number)))
        first = np.flatnonzero(~joined)
        self.ks, self.ke, self.rows, self.kinds = ks[first], ke[np.append(first[1:], len(ks)) - 1], rows[first], kinds[first]
        self.hashes = np.where(self.kinds > 0, _PLACE_HASH[self.kinds], self.hashes[first])

    def windows(self, n: int = WINDOW, short: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, first tokens and lengths of all windows; ``short``: of whole short rows too."""
        h, at = gram_hashes(self.hashes, self.rows, n)
        yield h, at, np.full(len(at), n)
        if short and len(self.rows):
            row, start, count = np.unique(self.rows, return_index=True, return_counts=True)
            for size in range(1, n):
                h, at = gram_hashes(self.hashes, self.rows, size)
                here = np.isin(at, start[count == size])
                yield h[here], at[here], np.full(int(here.sum()), size)

    def told(self, at: int, n: int) -> tuple[str, list[str]]:
        """Template and slot values (A-Z lower-cased) of a window."""
        template, slots = [], []
        for i in range(at, at + n):
            word = bytes(self.low[self.ks[i] : self.ke[i]]).decode("utf-8", "replace")
            kind = PLACEHOLDERS.get(int(self.kinds[i]))
            template.append(kind or word)
            if kind:
                slots.append(f"{kind}{word}")
        return " ".join(template), slots


def _with_windows(df: DataFrame, keep, short: bool, sizes: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """The rows of ``df`` (id, text) with their windows that ``keep`` admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = Tokens(batch.column("text"))
            base = np.searchsorted(tokens.rows, np.arange(batch.num_rows))
            for size in sizes:
                for h, at, n in tokens.windows(size, short and size == WINDOW):
                    h = h.astype(np.int64)
                    if keep is not None:
                        ok = keep(h)
                        h, at, n = h[ok], at[ok], n[ok]
                    for i in range(0, len(h), 4096):
                        told = [tokens.told(int(a), int(k)) for a, k in zip(at[i : i + 4096], n[i : i + 4096], strict=True)]
                        row = tokens.rows[at[i : i + 4096]]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("id").take(pa.array(row)),
                                pa.array(h[i : i + 4096]),
                                pa.array((at[i : i + 4096] - base[row]).astype(np.int32)),
                                pa.array([t for t, _ in told], pa.string()),
                                pa.array([s for _, s in told], pa.list_(pa.string())),
                            ],
                            ["id", "h", "pos", "template", "slots"],
                        )

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, {WINDOW_FIELDS}")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, h, template, slots, and whether the window proves a leak with any slots (loose) or with its own (exact)."""
    windows = written(_with_windows(benchmark.select(F.col("item_id").alias("id"), "text"), None, True), "item-windows")
    words = windows.select("id", "h", "pos", F.posexplode(F.split("template", " ")).alias("i", "word"))
    # A token of an item counts once, however many windows hold it.
    uses = words.select("id", (F.col("pos") + F.col("i")).alias("at"), "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(uses.agg((F.sum("n") + 1000).alias("total")))  # one row
    bits = F.log2(F.col("total") / F.col("n"))
    bits = F.when(F.col("word").isin(list(PLACEHOLDERS.values())), 0.0).when(F.col("word").isin(FUNCTION), F.least(bits, F.lit(FUNCTION_BITS))).otherwise(bits)
    weights = uses.crossJoin(total).select("word", bits.alias("bits"))
    templates = windows.select("h", "template").distinct()
    sums = templates.withColumn("word", F.explode(F.split("template", " "))).join(weights, "word").groupBy("h", "template").agg(F.sum("bits").alias("bits"))
    slots = SLOT_BITS * F.size("slots")
    judged = windows.join(sums, ["h", "template"]).withColumns({"loose": F.col("bits") >= LEAST_BITS, "exact": F.col("bits") + slots >= LEAST_BITS})
    return judged.where("loose OR exact").select(F.col("id").alias("item_id"), "h", "template", "slots", "loose", "exact")


def _consistent() -> Column:
    """Whether ``slots`` can take the places of slots that are equal where ``pattern`` points to the same one."""
    return F.expr("""
        forall(sequence(1, size(pattern)), i -> size(slots) = 0 OR (
            slots[i - 1] = slots[pattern[i - 1] - 1] AND (slots[i - 1] NOT LIKE '<name>%' OR array_position(slots, slots[i - 1]) = pattern[i - 1])))""")


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The windows of ``docs`` (key, text) that an item has, too: key, pos, h, template, slots, item_id (the smallest of the
    items with that window; ``item_windows`` has all), verbatim."""
    theirs = written(item_windows(benchmark), "benchmark-windows")
    sketch = docs.sparkSession.sparkContext.broadcast(membership_sketch(theirs, "h", SKETCH_BITS))
    lengths = [r.n for r in theirs.select(F.size(F.split("template", " ")).alias("n")).distinct().collect()]  # WINDOW at most
    sizes = tuple(sorted(lengths)) or (WINDOW,)
    ours = written(_with_windows(docs.select(F.col(key).alias("id"), "text"), lambda h: in_sketch(sketch.value, h, SKETCH_BITS), False, sizes), "document-windows")
    pattern = F.transform("slots", lambda x: F.array_position("slots", x).cast("int"))
    least = F.min("item_id").alias("item_id")
    loose = theirs.where("loose").groupBy("h", F.col("template").alias("t"), pattern.alias("pattern")).agg(least)
    whole = F.xxhash64("h", "slots").alias("hs")
    exact = theirs.where("exact").groupBy(whole, F.col("template").alias("t"), F.col("slots").alias("s")).agg(least)
    by_template = spread_join(ours, loose, "h", "id").where((F.col("template") == F.col("t")) & (_consistent() | (F.size("pattern") == 0)))
    by_values = spread_join(ours.withColumn("hs", whole), exact, "hs", "id").where((F.col("template") == F.col("t")) & (F.col("slots") == F.col("s")))
    names = ["id", "pos", "h", "template", "slots", "item_id"]
    both = by_template.select(*names, F.lit(False).alias("verbatim")).unionByName(by_values.select(*names, F.lit(True).alias("verbatim")))
    one = both.groupBy("id", "pos", "h", "template", "slots").agg(F.min("item_id").alias("item_id"), F.bool_or("verbatim").alias("verbatim"))
    return one.withColumnRenamed("id", key)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document that shares a window with an item: key, item_id (the smallest), n_windows, n_verbatim."""
    found = matches(docs, benchmark, key).groupBy(key)
    return found.agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_windows"), F.count_if("verbatim").alias("n_verbatim"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that share a window with a benchmark item; rows with the same id and text go together."""
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("t"))
    bad = written(leaks(docs.select(key.alias("row_key"), "text"), benchmark, "row_key").select("row_key"), "leaking-rows")
    return drop_rows(docs, key, bad)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items)
