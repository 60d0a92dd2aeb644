"""Items of training mixes: donors drawn across songs, added voices, limits, and settings with overrides.

All draws are hashes of (seed, item, epoch) and a name of their own, so that a probability changes no other draw. Tracks are drawn by their
number and looked up by a join, so neither tracks nor items are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.scalar import uniform
from tactus.operators.series import index_rows
from tactus.sources.materialise import cut


def numbered(tracks: DataFrame, track: str, bucket: Column) -> tuple[DataFrame, int]:
    """(track and its number by order, number of tracks). bucket: an expression of the track that follows its order."""
    one = tracks.where(F.col(track).isNotNull()).select(track).distinct().withColumn("_all", F.lit(0))
    out = cut(index_rows(one, ["_all"], [track], bucket, "number").drop("_all"), "numbered")
    return out, out.count()


def _seed(seed: int, item: str, epoch: int) -> Column:
    return F.concat_ws("/", F.lit(str(seed)), F.col(item), F.lit(str(epoch)))


def remix_donors(items: DataFrame, tracks: DataFrame, item: str, track: str, bucket: Column, sources: int, p: float, seed: int = 0, epoch: int = 0, own: bool = True) -> DataFrame:
    """(item, source, track, seed): which track gives each source of an item, and the seed that it is rendered with.

    With probability p an item is a remix: every source comes from a track drawn for it. Other items are their own track's. own: an item's own track may be drawn; else only others are, each equally likely (with
    one track, that one). Items whose track is null or unknown stay out.
    """
    table, n = numbered(tracks, track, bucket)
    base = _seed(seed, item, epoch)
    known = items.select(item, track).join(table, track)
    each = known.withColumn("remix", uniform(base, "remix") < p).select(item, F.col("number").alias("_own"), "remix", F.explode(F.sequence(F.lit(0), F.lit(sources - 1))).alias("source"))
    u = lambda stream: uniform(F.concat_ws("/", base, "source"), stream)
    among = n if own or n < 2 else n - 1
    drawn = F.floor(u("donor") * among)
    if among < n:
        drawn = drawn + (drawn >= F.col("_own")).cast("long")
    each = each.select(item, "source", F.when(F.col("remix"), drawn).otherwise(F.col("_own")).alias("number"), F.when(F.col("remix"), F.floor(u("seed") * (2**31 - 1))).alias("seed"))
    return each.join(table, "number").select(item, "source", track, "seed")


def limit(mixed: DataFrame, item: str, mix: str, values: list[str], peak: float = 0.95) -> DataFrame:
    """Scales the columns `values` of each item (numbers or arrays) so that |mix| stays within peak; items below it keep their level. Adds scale."""
    top = mixed.groupBy(item).agg(F.least(F.lit(1.0), F.lit(peak) / F.greatest(F.max(F.abs(mix)), F.lit(1e-9))).alias("scale"))
    out = mixed.join(top, item)
    arrays = {f.name for f in mixed.schema.fields if f.dataType.typeName() == "array"}
    return out.withColumns({v: F.transform(v, lambda x: x * F.col("scale")) if v in arrays else F.col(v) * F.col("scale") for v in values})


def remix(donors: DataFrame, signals: DataFrame, item: str, track: str, idx: str, sources: int, peak: float = 0.95) -> DataFrame:
    """(item, idx, sources, mix, scale): the items' signals, each source from its donor, and their sum, within the peak. signals: track, idx, sources (array); samples that a donor lacks are 0."""
    s = signals.select(track, idx, F.posexplode("sources").alias("source", "_v"))
    joined = donors.join(s, [track, "source"])
    values = [F.coalesce(F.sum(F.when(F.col("source") == k, F.col("_v"))), F.lit(0.0)) for k in range(sources)]
    mixed = joined.groupBy(item, idx).agg(F.array(*values).alias("sources"))
    mixed = mixed.withColumn("mix", F.aggregate("sources", F.lit(0.0), lambda a, x: a + x))
    return limit(mixed, item, "mix", ["sources", "mix"], peak)


def add_voice(samples: DataFrame, voices: DataFrame, item: str, idx: str, source: int, p: float, gain_db: tuple[float, float] = (-6.0, 6.0), seed: int = 0, epoch: int = 0, peak: float = 0.95) -> DataFrame:
    """samples (item, idx, sources, mix) with, for a share p of items, a voice (item, idx, voice) added to one source and the mix at a drawn gain, then limited. Adds added and scale.

    Both draws are made for every item. Items without the voice keep their level, even above the peak; samples that the voice lacks have 0 of it.
    """
    base = _seed(seed, item, epoch)
    joined = samples.join(voices.select(item, idx, "voice"), [item, idx], "left")
    gain = F.pow(F.lit(10.0), (gain_db[0] + (gain_db[1] - gain_db[0]) * uniform(base, "gain")) / 20)
    joined = joined.withColumn("added", uniform(base, "voice") < p)
    more = F.when(F.col("added"), F.coalesce(F.col("voice").cast("double"), F.lit(0.0)) * gain).otherwise(0.0)
    joined = joined.withColumn("voice", more)
    joined = joined.withColumns({"sources": F.transform("sources", lambda x, k: x + F.when(k == source, F.col("voice")).otherwise(0.0)), "mix": F.col("mix") + F.col("voice")}).drop("voice")
    done = limit(joined.where("added"), item, "mix", ["sources", "mix"], peak)
    return done.unionByName(joined.where("not added").withColumn("scale", F.lit(1.0)))


def overridden(settings: Column, over: Column) -> Column:
    """A map of settings with the entries of another on top, null ones included; a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(settings, none), F.coalesce(over, none)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))


def nested_subsets(songs: DataFrame, song: str, sizes: list[int], bucket: Column, first: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(size, song) of nested subsets: the first `size` songs of one order, the named ones and then all others by a seeded hash.

    bucket: an expression of the column _draw (0 to 1) that follows its order. A named song that isn't there, or a size above the number of songs, is an error.
    """
    named = list(dict.fromkeys(first or []))
    draw = uniform(F.concat_ws("/", F.lit(str(seed)), song), "subset")
    place = F.array_position(F.lit(named).cast("array<string>"), F.col(song).cast("string")) if named else F.lit(0)
    all_ = songs.where(F.col(song).isNotNull()).select(song).distinct().withColumns({"_named": F.when(place > 0, place), "_draw": draw, "_all": F.lit(0)})
    ranked = index_rows(all_.where("_named is null"), ["_all"], ["_draw", song], bucket, "_place").withColumn("_place", F.col("_place") + len(named))
    ordered = cut(ranked.select(song, "_place").unionByName(all_.where("_named is not null").select(song, (F.col("_named") - 1).alias("_place"))), "order")
    n, found = ordered.agg(F.count("*"), F.count_if(F.col("_place") < len(named))).first()
    if found < len(named):
        raise ValueError(f"{len(named) - found} of the named songs aren't there")
    if max(sizes, default=0) > n:
        raise ValueError(f"{n} songs, {max(sizes)} asked")
    return ordered.select(F.explode(F.filter(F.lit(sizes), lambda s: s > F.col("_place"))).alias("size"), song)
