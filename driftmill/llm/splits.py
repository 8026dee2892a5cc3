"""Splits that keep related records together: label propagation, then stratified assignment of whole groups."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.operators.skew import lookup, prefix_sum
from driftmill.runtime import Cut, cut, unit_hash

#: Marks the generator puts at either end of a family name, and values that name nothing. Fixed values.
FAMILY_MARKS = ("open", "closed", "backward", "forward", "full", "normalized", "normalised")
PLACEHOLDERS = ("", "unknown", "n/a")

#: Edges of one entity that one task may hold; an entity with more is cut into slices of this size.
SLICE = 100_000
#: Names of one component that are paired with the others in one task.
NAMES = 1000
#: Labels to stratify by at most: the driver holds a counter of each for every split and size class.
MAX_LABELS = 10_000
#: A group with at least 1/HEAVY of all records is placed on its own; there can be no more than HEAVY such groups.
HEAVY = 1000
SPLITS = ("train", "validation", "test")


def names_something(col: Column) -> Column:
    return col.isNotNull() & ~F.lower(F.trim(F.regexp_replace(col, r"\s+", " "))).isin(*PLACEHOLDERS)


def family_key(col: Column) -> Column:
    """The family a written value names: no letter case, blanks, separators, or marks at either end.

    Marks are words of their own; in a value whose separators are gone they are cut off the one word that is left
    (an ``openapi`` at its start is a name, not a mark). A value of marks only names itself.
    """
    marks = "|".join(FAMILY_MARKS)
    words = F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(F.regexp_replace(words, rf"^(?:(?:{marks}) )+", ""), rf"(?: (?:{marks}))+$", "")
    glued = F.regexp_replace(F.regexp_replace(bare, rf"^(?:(?:{marks})(?<!open(?=api)))+", ""), rf"(?:{marks})+$", "")
    one = F.when(~bare.contains(" ") & (glued != ""), glued).otherwise(F.regexp_replace(bare, " ", ""))
    return F.when(names_something(col) & (bare != ""), one)


@dataclass
class Components:
    """labels: (entity, label), links: distinct entity combinations. A label is the least entity of a component."""

    keyed: DataFrame
    labels: DataFrame
    entities: list[str]
    rounds: int


def _entity_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit ids of the entities, columns e0, e1, ...; a seed under which two names collide is not used."""
    for seed in range(16):
        ids = [F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(seed), F.lit(i), F.col(k))).alias(f"e{i}") for i, k in enumerate(keys)]
        keyed = df.select("*", *ids)
        named = keyed.select(F.explode(F.array(*[F.struct(F.col(f"e{i}").alias("id"), F.concat(F.lit(f"{i}:"), F.col(k)).alias("name")) for i, k in enumerate(keys)])).alias("x")).filter("x.id is not null")
        clash = named.groupBy("x.id").agg(F.min("x.name").alias("a"), F.max("x.name").alias("b")).filter("a <> b")
        if clash.isEmpty():
            return keyed
    raise ValueError("no seed without a collision of entity ids")


def components(records: DataFrame, keys: list[str], max_rounds: int = 200) -> Components:
    """Connected components of the bipartite graph of records and the entities in the columns ``keys``.

    Records with the same entities are one link node. A round takes, for every link, the least label of its
    entities, for every entity the least of its links, and then the label of that label (which halves what is
    left of long chains). It ends when no label changes. Each round is two shuffles of links and one of entities;
    both minima are combined before they are shuffled. Every entity with more than SLICE links is cut into slices, each of
    which meets its own copy of the label; labels that many entities share are looked up apart. A null key names no
    entity.
    """
    keyed = _entity_ids(records, keys)
    keyed = cut(keyed.drop(*keys), "p1-keyed")  # names have become ids
    ids = [f"e{i}" for i in range(len(keys))]
    links = keyed.select(*ids).distinct()
    edges = links.select(*ids, F.explode(F.array_compact(F.array(*ids))).alias("entity"))
    held = [Cut(edges, "p1-edges")]  # superseded by the labels
    edges = held[0].df
    degree = edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    held.append(Cut(degree.select("entity", F.ceil(F.col("n") / SLICE).cast("int").alias("fan")), "p1-fans"))
    fans = held[-1].df
    wide = fans.filter("fan > 1")
    if wide.isEmpty():
        edges = edges.withColumn("slice", F.lit(0))
    else:
        held.append(Cut(lookup(edges, wide, ["entity"]).select(*ids, "entity", F.pmod(F.xxhash64(*ids), F.coalesce("fan", F.lit(1))).cast("int").alias("slice")), "p1-slices"))
        edges = held[-1].df
    now = Cut(fans.select("entity", "fan", F.col("entity").alias("label")), "p1-labels")
    for rounds in range(1, max_rounds + 1):
        labels = now.df
        sliced = labels.select("entity", "label", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"))
        of_link = edges.join(sliced, ["entity", "slice"]).groupBy(*ids).agg(F.min("label").alias("m"))
        of_entity = of_link.select("m", F.explode(F.array_compact(F.array(*ids))).alias("entity")).groupBy("entity").agg(F.min("m").alias("m"))
        lowered = labels.join(of_entity, "entity").select("entity", "fan", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = Cut(lowered, "p1-step")
        # a giant component's entities share a label: lookup sends such labels through a broadcast
        moved = step.df.filter("label <> entity").select(F.col("entity").alias("label"), F.col("label").alias("jump"))
        jumped = lookup(step.df, moved, ["label"]).select("entity", "fan", "was", F.coalesce("jump", "label").alias("label"))
        new = Cut(jumped, "p1-labels")
        changed = new.df.filter("label <> was").limit(1).count()
        step.drop()
        now.drop()
        now = new
        if not changed:
            break
    else:
        raise ValueError(f"labels still change after {max_rounds} rounds")
    for table in held:
        table.drop()
    return Components(keyed, now.df.select("entity", "label"), ids, rounds)


def record_components(records: DataFrame, record_id: str, keys: list[str], carry: str | None = None) -> DataFrame:
    """(record_id, component) and the least ``carry``: every distinct record with the component it belongs to.

    A record that names no entity is a component of its own. Repeated rows of a record count once; if they name different
    entities, all these are joined through the record. Other records with the same entities are one link, however many.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = records.select(F.col(record_id).alias("_r"), (F.col(carry) if carry else F.lit(None).cast("string")).alias("_c"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    written = Cut(rows.groupBy("_r", *names).agg(F.min("_c").alias("_c")), "p1-records")
    only = written.df
    # an entity of the record itself joins rows of one record that disagree
    torn = only.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _r is not null")
    marked = lookup(only, torn, ["_r"]).withColumn("_self", F.when(F.col("_n") > 1, F.col("_r").cast("string"))).drop("_n")
    found = components(marked, [*names, "_self"])
    written.drop()  # all is in found.keyed
    placed = lookup(found.keyed.select("_r", "_c", F.coalesce(*found.entities).alias("entity")), found.labels, ["entity"])
    per = placed.groupBy("_r").agg(F.min("label").alias("component"), F.min("_c").alias("_c"))
    alone = F.when(F.col("_r").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit("alone"), F.col("_r")))
    return per.select(F.col("_r").alias(record_id), F.coalesce("component", alone).alias("component"), *([F.col("_c").alias(carry)] if carry else []))


def same_component_names(records: DataFrame, written: str, keys: list[str]) -> DataFrame:
    """(name_a, name_b), name_a < name_b in byte order: values of ``written`` whose records share a component.

    ``keys[0]`` must be the key column of ``written``. Rows whose key is null give no name. The names of a component with
    more than NAMES of them are cut into slices, each of which meets all the others.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    found = components(records.select(F.col(written).alias("_w"), *[F.col(k).alias(n) for k, n in zip(keys, own)]).distinct(), own)
    names = found.keyed.filter("e0 is not null").select(F.col("_w").alias("name"), F.col("e0").alias("entity")).distinct()
    placed = lookup(names, found.labels, ["entity"]).select("name", F.col("label").alias("component"))
    placed = cut(placed, "p1-names")
    fans = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / NAMES).cast("int").alias("fan")).filter("fan > 1")
    sized = placed
    if fans.isEmpty():
        sized = placed.withColumn("fan", F.lit(1))
    else:
        sized = cut(lookup(placed, fans, ["component"]).withColumn("fan", F.coalesce("fan", F.lit(1))), "p1-sized")
    left = sized.select(F.col("name").alias("name_a"), "component", F.pmod(F.xxhash64("name"), F.col("fan")).cast("int").alias("slice"))
    right = sized.select(F.col("name").alias("name_b"), "component", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"))
    return left.join(right, ["component", "slice"]).filter("name_a < name_b").select("name_a", "name_b")


def _valid(ratios: tuple[float, float, float]) -> bool:
    return all(r is not None and math.isfinite(r) and r >= 0 for r in ratios) and abs(sum(ratios) - 1) < 1e-6 and ratios[0] > 0


def _greedy(groups: list[tuple[object, dict[str, int]]], goal: dict[str, list[float]], placed: dict[str, list[float]]) -> dict[object, int]:
    """Each group, the largest first, to the split where the squared deviation from the goal grows least."""
    out: dict[object, int] = {}
    for key, counts in sorted(groups, key=lambda g: (-sum(g[1].values()), str(g[0]))):
        def cost(s: int) -> float:
            total = 0.0
            for lab, n in counts.items():
                g, p = goal[lab][s], placed[lab][s]
                total += ((p + n - g) ** 2 - (p - g) ** 2) / max(sum(goal[lab]), 1.0)
            g, p, n = goal["*"][s], placed["*"][s], sum(counts.values())
            return total + ((p + n - g) ** 2 - (p - g) ** 2) / max(sum(goal["*"]), 1.0)

        best = min(range(3), key=lambda s: (cost(s), s))
        out[key] = best
        for lab, n in counts.items():
            placed[lab][best] += n
        placed["*"][best] += sum(counts.values())
    return out


def assign_splits(grouped: DataFrame, record_id: str, label: str, ratios: tuple[float, float, float], seed: int | str) -> DataFrame:
    """(record_id, component, split) from distinct (record_id, component, label).

    Groups with at least 1/1000 of all records (no more than 1000 of them) are placed one after the other, each
    where the label distribution of the splits departs least from the whole's. All other groups are put in strata
    by their commonest label and size class; a stratum's records are shared out to the splits in proportion to what
    each still lacks of that label, and its groups are taken in an order drawn from the seed, by exact running sums.
    A null label is a label of its own. Raises ValueError where the ratios are no valid configuration; more than
    10,000 different labels are refused too, since the plan holds one counter for each.
    """
    if not _valid(ratios):
        raise ValueError(f"not a valid split configuration: {ratios}")
    spark = grouped.sparkSession
    rows = grouped.select(record_id, "component", F.coalesce(F.col(label), F.lit("<null>")).alias("label"))
    by_label = rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    sized = by_label.groupBy("component").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label"))["label"].alias("main"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    sized = cut(sized, "p1-groups")
    totals = {r["label"]: r["n"] for r in sized.select(F.explode("counts").alias("label", "c")).groupBy("label").agg(F.sum("c").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels to stratify by")
    everything = sum(totals.values())
    goal = {lab: [n * r for r in ratios] for lab, n in [*totals.items(), ("*", everything)]}
    placed = {lab: [0.0] * 3 for lab in goal}
    floor = max(1, math.ceil(everything / HEAVY))
    heavy = [(r["component"], r["counts"]) for r in sized.filter(F.col("size") >= floor).select("component", "counts").collect()]  # no more than HEAVY
    where = _greedy(heavy, goal, placed)

    light = sized.filter(F.col("size") < floor).select("component", "size", "main", F.floor(F.log2("size")).cast("int").alias("class"), unit_hash(seed, F.col("component")).alias("u"))
    strata = light.groupBy("main", "class").agg(F.sum("size").alias("n")).collect()  # at most MAX_LABELS x 64 classes
    cuts = []
    for r in sorted(strata, key=lambda r: (-r["class"], r["main"])):
        lacks = [max(goal[r["main"]][s] - placed[r["main"]][s], 0.0) for s in range(3)]
        whole = [max(goal["*"][s] - placed["*"][s], 0.0) for s in range(3)]
        weights = lacks if sum(lacks) > 0 else whole if sum(whole) > 0 else list(ratios)
        share = [w / sum(weights) for w in weights]
        for s in range(3):
            placed[r["main"]][s] += r["n"] * share[s]
            placed["*"][s] += r["n"] * share[s]
        cuts.append((r["main"], r["class"], r["n"] * share[0], r["n"] * (share[0] + share[1])))
    bounds = spark.createDataFrame(cuts or [("", -1, 0.0, 0.0)], "main string, class int, up_to_train double, up_to_validation double")
    summed = prefix_sum(light.withColumn("bucket", F.floor(F.col("u") * 1024).cast("int")), ["main", "class"], "bucket", [F.col("u"), F.col("component")], "size", "upto")
    middle = F.col("upto") - F.col("size") / 2
    chosen = summed.join(F.broadcast(bounds), ["main", "class"]).select(
        "component", F.when(middle <= F.col("up_to_train"), SPLITS[0]).when(middle <= F.col("up_to_validation"), SPLITS[1]).otherwise(SPLITS[2]).alias("split")
    )
    if where:
        chosen = chosen.unionByName(spark.createDataFrame([(k, SPLITS[s]) for k, s in where.items()], "component long, split string"))
    return lookup(rows.select(record_id, "component", "label"), chosen, ["component"])


def split_report(assigned: DataFrame) -> DataFrame:
    """Per split and label: records, their share of the split, the label's share of everything, the deviation."""
    n = assigned.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_records"))
    in_split, of_label = Window.partitionBy("split"), Window.partitionBy("label")
    everything = Window.partitionBy()  # splits x labels: at most 3 x MAX_LABELS rows
    return (
        n.withColumn("share", F.col("n_records") / F.sum("n_records").over(in_split))
        .withColumn("overall", F.sum("n_records").over(of_label) / F.sum("n_records").over(everything))
        .select("split", "label", "n_records", F.round("share", 6).alias("share_in_split"), F.round("overall", 6).alias("share_overall"), F.round(F.abs(F.col("share") - F.col("overall")), 6).alias("deviation"))
    )
