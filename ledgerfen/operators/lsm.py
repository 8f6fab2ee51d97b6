"""Sorted runs and levels: flush, listing, sparse index, filters, layered look-up and compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codecs import bloom_bits, bloom_h1, bloom_h2, bloom_hashes, bloom_positions, fixed_hex, varint_length
from ..session import if_small, materialize
from .folds import split_outputs
from .kvlog import DELETE, POINTER, latest_listing
from .ordered import running
from .small_files import entry_bytes, true_sizes
from .state import latest

L0_FILES, L1_BYTES, LEVELS = 4, 10 << 20, 7


def flush(runs: DataFrame) -> DataFrame:
    """(shard, run_id, pos, key, seq, vtype): each memtable's last mutation of each key, tombstones too, in key order from 0.

    A memtable is bounded in size, so the numbering within it is no large group.
    """
    entries = latest(runs, ["shard", "run_id", "key"], ["vtype"])
    order = W.partitionBy("shard", "run_id").orderBy("key")
    return entries.select("shard", "run_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", "seq", "vtype")


def listing(entries: DataFrame, file: list[str], interval: int = 16) -> DataFrame:
    """(file, num_entries, smallest_key, largest_key, file_size) of sorted files of entries (key, pos)."""
    k = F.octet_length("key").cast("long")
    own = varint_length(k, 5) + k + 25
    index = F.when(F.col("pos") % interval == 0, varint_length(k, 5) + k + 8).otherwise(0)
    body = F.sum(own + index)
    n = F.count(F.lit(1))
    return entries.groupBy(*file).agg(
        n.alias("num_entries"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), (body + 4 + bloom_bits(n) / 8 + 48).cast("long").alias("file_size")
    )


def sparse_index(sst: DataFrame, interval: int = 16) -> DataFrame:
    """(db_id, sst_id, key, data_offset, block_end): every ``interval``-th entry's key, where its block begins and ends."""
    rows = _offsets(sst).where(F.col("pos") % interval == 0)
    end = F.lead("data_offset").over(W.partitionBy("db_id", "sst_id").orderBy("pos"))
    return rows.select("db_id", "sst_id", "key", "data_offset", F.coalesce(end, F.col("data_end")).alias("block_end"))


def _offsets(sst: DataFrame) -> DataFrame:
    """Distinct entries with their offset in the file, and the file's end of data; files are bounded by the size they are closed at."""
    rows = sst.select("db_id", "sst_id", "pos", "key", "vtype", "seq", *POINTER).distinct().withColumn("size", entry_bytes())
    file = W.partitionBy("db_id", "sst_id")
    before = file.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({"data_offset": F.coalesce(F.sum("size").over(before), F.lit(0)), "data_end": F.sum("size").over(file)})


def sparse_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(db_id, sst_id, key, block, block_end) of probes (db_id, sst_id, key): the block of the greatest index key not above the
    probe's, the first block for probes below all. Backward as-of look-up: index and probes are sorted together, in ranges that
    split a file that is asked for most.

    Probes of files without an index aren't answered. Of two blocks with the same first key the later one is taken.
    """
    marks = index.select("db_id", "sst_id", "key", F.lit(0).alias("probe"), F.struct("data_offset", "block_end").alias("block"))
    asked = probes.select("db_id", "sst_id", "key").distinct().select("db_id", "sst_id", "key", F.lit(1).alias("probe"), F.lit(None).cast("struct<data_offset:bigint,block_end:bigint>").alias("block"))
    both = running(marks.unionByName(asked), ["db_id", "sst_id"], ["key", "probe", "block"], {"at": ("last", "block")}, inclusive=True)
    first = index.groupBy(F.col("db_id").alias("_db"), F.col("sst_id").alias("_file")).agg(F.min(F.struct("data_offset", "block_end")).alias("first"))
    found = both.where("probe = 1").join(first, (F.col("db_id") == F.col("_db")) & (F.col("sst_id") == F.col("_file")))
    block = F.coalesce("at", "first")
    return found.select("db_id", "sst_id", "key", block["data_offset"].alias("block"), block["block_end"].alias("block_end"))


def build_blooms(entries: DataFrame, file: list[str], bits_per_key: int = 10) -> DataFrame:
    """(file, num_hashes, num_bits, word_no, word): a filter for each file, in words of 64 bits; words without bits are left out.

    The hashes are worked out in batches; positions, words and their union are built-in aggregations on (file, word).
    """
    hashes = bloom_hashes(bits_per_key)
    keys = entries.where("key IS NOT NULL").select(*file, "key").distinct()
    sizes = keys.groupBy(*file).agg(bloom_bits(F.count(F.lit(1)), bits_per_key).alias("num_bits"))
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in file), "num_bits")
    sized = keys.join(sizes, _same_file(file)).select(*file, "num_bits", bloom_h1("key").alias("h1"), bloom_h2("key").alias("h2"))
    at = sized.select(*file, "num_bits", F.explode(bloom_positions(F.col("h1"), F.col("h2"), F.col("num_bits"), hashes)).alias("p"))
    word = F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("word")
    words = at.groupBy(*file, "num_bits", F.floor(F.col("p") / 64).cast("long").alias("word_no")).agg(word)
    return words.select(*file, F.lit(hashes).alias("num_hashes"), "num_bits", "word_no", "word")


def _same_file(file: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in file))


def bloom_bytes(blooms: DataFrame, file: list[str]) -> DataFrame:
    """(file, num_hashes, bits): the filters as byte strings, a file's at a time; files are bounded by the size they are closed at."""
    words = F.map_from_entries(F.collect_list(F.struct("word_no", fixed_hex(F.col("word"), 8))))
    one = blooms.groupBy(*file, "num_hashes", "num_bits").agg(words.alias("w"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("num_bits") - 1) / 64)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit("0" * 16)))
    return one.select(*file, "num_hashes", F.unhex(F.substring(F.array_join(every, ""), F.lit(1), (F.col("num_bits") / 4).cast("int"))).alias("bits"))


def may_contain(blooms: DataFrame, probes: DataFrame, file: list[str]) -> DataFrame:
    """(file, key, maybe) of the distinct probes of files with a filter: whether all of the key's bits are set; an empty filter holds nothing.

    Each bit is looked up in its word by a join on (file, word), so no row has a filter in it and a file that is asked for
    most is no hot one.
    """
    sizes = blooms.select(*(F.col(c).alias(f"_{c}") for c in file), "num_hashes", "num_bits").distinct()
    asked = probes.where("key IS NOT NULL").select(*file, "key").distinct().join(sizes, _same_file(file))
    asked = asked.select(*file, "key", "num_hashes", "num_bits", bloom_h1("key").alias("h1"), bloom_h2("key").alias("h2"))
    place = F.transform(F.sequence(F.lit(0), F.col("num_hashes") - 1), lambda i: F.pmod(F.col("h1") + i.cast("long") * F.col("h2"), F.col("num_bits")))
    bits = asked.select(*file, "key", F.explode(place).alias("p")).withColumn("_no", F.floor(F.col("p") / 64).cast("long"))
    words = blooms.select(*(F.col(c).alias(f"_{c}") for c in file), "word_no", "word")
    both = bits.join(words, _same_file(file) & (F.col("_no") == F.col("word_no")), "left")
    is_set = F.coalesce(F.expr("(shiftright(word, CAST(p % 64 AS INT)) & 1) = 1"), F.lit(False))
    return both.groupBy(*file, "key").agg(F.bool_and(is_set).alias("maybe"))


def current_entries(sst: DataFrame, manifest: DataFrame, distinct: bool = False) -> DataFrame:
    """Entries of the current files with the level of their listing; repeated rows are merged only if ``distinct``, as argmax needs no merging."""
    files = latest_listing(manifest).where("removed_at IS NULL").select("db_id", F.col("file_id").alias("sst_id"), "level")
    rows = sst.select("db_id", "sst_id", "pos", "key", "vtype", "seq", *POINTER)
    rows = rows.join(if_small(files, manifest.count()), ["db_id", "sst_id"])
    return rows.distinct() if distinct else rows


def layered_get(entries: DataFrame) -> DataFrame:
    """(db_id, key, level, sst_id, seq, vtype) of the first layer that has a key: level 0 newest file first, then level by level."""
    newest = F.when(F.col("level") == 0, -F.col("sst_id")).otherwise(F.col("sst_id"))
    first = F.min(F.struct("level", newest.alias("place"), "pos", "sst_id", "seq", "vtype")).alias("r")
    return entries.groupBy("db_id", "key").agg(first).select("db_id", "key", "r.level", "r.sst_id", "r.seq", "r.vtype")


def memtable_get(runs: DataFrame, immutable: int = 3) -> DataFrame:
    """(shard, key, layer, run_id, seq, vtype) of the first layer that has a key, of ``folds.memtable_runs``: the open memtable, the
    ``immutable`` ones before it, newest first, then the tables of the runs flushed."""
    newest = runs.groupBy(F.col("shard").alias("_shard")).agg(F.max("run_id").alias("open"))
    last = latest(runs, ["shard", "key"], ["seq", "vtype"], "run_id")
    rows = last.join(newest, F.col("shard") == F.col("_shard"))
    age = F.col("open") - F.col("run_id")
    layer = F.when(age == 0, "memtable").when(age <= immutable, "immutable").otherwise("table")
    return rows.select("shard", "key", layer.alias("layer"), "run_id", "seq", "vtype")


def overlap(files: DataFrame, level: int) -> DataFrame:
    """(db_id, file_id, level) of what a compaction of ``level`` reads: its files, and those of the next level that touch the
    hull of their keys, also in gaps between them. The hulls are one row a database."""
    own = files.where(F.col("level") == level)
    hull = own.groupBy("db_id").agg(F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi"))
    nxt = files.where(F.col("level") == level + 1).join(hull, "db_id").where("smallest_key <= hi AND largest_key >= lo")
    return own.select("db_id", "file_id", "level").unionByName(nxt.select("db_id", "file_id", "level"))


def overlap_inputs(manifest: DataFrame, level: int) -> DataFrame:
    """``overlap`` of the current files of a manifest."""
    return overlap(latest_listing(manifest).where("removed_at IS NULL"), level)


def merge(entries: DataFrame, inputs: DataFrame, level: int) -> DataFrame:
    """(db_id, key, seq, vtype, pointer, dropped): the newest entry of each key of the input files; ``dropped`` marks the
    tombstones of keys that no file of a level from ``level`` + 2 on has, tombstones there included."""
    files = if_small(inputs.select("db_id", F.col("file_id").alias("sst_id")), inputs.count())
    newest = latest(entries.join(files, ["db_id", "sst_id"], "left_semi"), ["db_id", "key"], ["vtype", *POINTER])
    deeper = entries.where(F.col("level") >= level + 2).select("db_id", "key").distinct().withColumn("below", F.lit(True))
    marked = newest.join(deeper, ["db_id", "key"], "left")
    dropped = (F.col("vtype") == DELETE) & F.col("below").isNull()
    return marked.select("db_id", "key", "seq", "vtype", *POINTER, dropped.alias("dropped"))


def compact_level(entries: DataFrame, inputs: DataFrame, level: int, limit: int) -> DataFrame:
    """(db_id, out_no, key, seq, vtype, pointer): the outputs of a compaction, split at ``limit`` bytes of entries, a database a stream."""
    kept = merge(entries, inputs, level).where("NOT dropped").drop("dropped").withColumn("size", entry_bytes())
    return split_outputs(kept, "db_id", ["key"], "size", limit).drop("size")


def compact_range(entries: DataFrame, limit: int, levels: int = LEVELS) -> DataFrame:
    """``entries`` (db_id, sst_id, level, pos and the entry) after compacting every level but the last, from the first one on.

    What a level has moves to the next one, merged with the files there that it touches; in the end all is in the last level.
    New files are numbered above those of their database. Of each level only the outputs are written; which files count, and in
    which level, is a listing of its own.
    """
    columns = ["db_id", "sst_id", "pos", "key", "vtype", "seq", *POINTER]
    files = materialize(_key_ranges(entries), "files")
    ever, written = files, [entries.select(columns)]
    for level in range(levels - 1):
        inputs = materialize(overlap(files, level), "inputs")
        count = inputs.count()
        if not count:
            continue
        now = _of_listing(written, files)
        top = ever.groupBy("db_id").agg(F.max("file_id").alias("top"))
        order = W.partitionBy("db_id", "sst_id").orderBy("key")  # a file is bounded by the limit
        out = compact_level(now, inputs, level, limit).join(top, "db_id").withColumn("sst_id", F.col("top") + 1 + F.col("out_no"))
        out = materialize(out.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).select(columns), "outputs")
        new = materialize(_key_ranges(out.withColumn("level", F.lit(level + 1))), "files")
        files = materialize(files.join(if_small(inputs.select("db_id", "file_id"), count), ["db_id", "file_id"], "left_anti").unionByName(new), "files")
        ever, written = ever.unionByName(new), [*written, out]
    return _of_listing(written, files)


def _key_ranges(entries: DataFrame) -> DataFrame:
    return entries.groupBy("db_id", F.col("sst_id").alias("file_id"), "level").agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


def _of_listing(written: list[DataFrame], files: DataFrame) -> DataFrame:
    """The entries of the files that are listed, with the level of the listing."""
    every = reduce(DataFrame.unionByName, written)
    return every.join(if_small(files.select("db_id", F.col("file_id").alias("sst_id"), "level"), files.count()), ["db_id", "sst_id"])


def after_compaction(entries: DataFrame, inputs: DataFrame, level: int) -> DataFrame:
    """The live state of all current files after the compaction: merged entries in place of those of the input files."""
    files = if_small(inputs.select("db_id", F.col("file_id").alias("sst_id")), inputs.count())
    rest = entries.join(files, ["db_id", "sst_id"], "left_anti")
    kept = merge(entries, inputs, level).where("NOT dropped")
    cols = ["db_id", "key", "seq", "vtype", *POINTER]
    return latest(rest.select(cols).unionByName(kept.select(cols)), ["db_id", "key"], ["vtype", *POINTER]).where("vtype = 1")


def policy(manifest: DataFrame, sst: DataFrame) -> DataFrame:
    """(db_id, level, files, bytes, byte_limit, due) of each level: level 0 is due at four files, others above their size.

    Levels without files are listed with zeros. Sizes are the true ones.
    """
    files = latest_listing(manifest).where("removed_at IS NULL").select("db_id", "file_id", "level")
    sizes = true_sizes(sst).select("db_id", F.col("sst_id").alias("file_id"), "bytes")
    have = files.join(sizes, ["db_id", "file_id"], "left").groupBy("db_id", "level").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("bytes", F.lit(60))).alias("bytes"))
    every = files.select("db_id").distinct().select("db_id", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    both = every.join(have, ["db_id", "level"], "left").fillna(0, ["files", "bytes"])
    limit = F.when(F.col("level") > 0, (L1_BYTES * F.pow(F.lit(10), F.col("level") - 1)).cast("long"))
    due = F.when(F.col("level") == 0, F.col("files") >= L0_FILES).otherwise(F.col("bytes") > limit)
    return both.select("db_id", "level", "files", "bytes", limit.alias("byte_limit"), due.alias("due"))
