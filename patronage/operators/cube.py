"""Revenue for any choice of filters from one kept cube, without items, orders or products.

Sums add up, so they are kept by grouping sets over what the filters choose by. Distinct orders and
buyers do not: for them the cube keeps, for each cell, who is in it, as bit positions in pages of 32 768
ids. A choice joins the bits of its cells in words of 64 and counts them, so an order or a buyer
that is in several cells counts once. All rows of a word go to one task, and the number of tasks follows
the size of the kept cube, so that the memory of one does not grow with it.

What moves between tasks are numbers: each combination of an order's, a user's or a product's values
that occurs has one, and the values come back behind the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions import calendar as cal
from patronage.functions.values import Bins, ratio
from patronage.operators.revenue import Filters, labelled_top, money, with_averages
from patronage.sources.store import free_shuffles, keep

OF_ORDER = ("order_month", "status")
OF_USER = ("gender", "age_group", "traffic_source")
OF_PRODUCT = ("category", "brand")
DIMENSIONS = (*OF_ORDER, *OF_USER, *OF_PRODUCT)
# The two grouping sets: each cell again by one of these.
BY_MONTH, BY_NAME = "month", "name"
ORDER, BUYER = "order", "buyer"
PAGE, WORD = 32_768, 64
# Rows of `members` that one task counts, about.
ROWS_A_TASK = 1 << 18
# Numbers of the combinations of an order's, a user's and a product's dimensions, and of a product's with its
# name. A cell is the three in one number, if they fit.
CODES = ("of_order", "of_user", "of_product")
OF_NAME = "of_name"
LONG = 1 << 63
# The large tables take some 0.6 of the disk that they do by default.
CODEC = "zstd"
# Numbers by id are sent to all tasks up to so many rows of 64 ids, which are counted first.
BROADCAST_WORDS = 1 << 17


@dataclass(frozen=True)
class CellNames:
    """What the numbers in a cell stand for: for each of `CODES` a frame of it and its dimensions, and how
    many numbers there are.
    """

    frames: tuple[DataFrame, ...]
    sizes: tuple[int, ...]

    def cell(self) -> Column:
        codes = [F.col(c) for c in CODES]
        if prod(self.sizes) >= LONG:
            return F.struct(*codes)
        cell = codes[0].cast("bigint")
        for code, size in zip(codes[1:], self.sizes[1:]):
            cell = cell * F.lit(size) + code
        return cell

    def of(self, df: DataFrame) -> DataFrame:
        """The frame with the dimensions of its `cell`."""
        below, apart = 1, isinstance(df.schema["cell"].dataType, T.StructType)
        for code, frame, size in reversed([*zip(CODES, self.frames, self.sizes)]):
            own = F.col(f"cell.{code}") if apart else F.expr(f"cell div {below}L % {size}L")
            df = df.withColumn(code, own.cast(frame.schema[code].dataType)).join(frame, code).drop(code)
            below *= size
        return df


@dataclass(frozen=True)
class RevenueCube:
    """`cells`: dimensions, `grain`, `month` or `name`, `revenue`. `members`: dimensions, `kind`,
    `page`, `bits`. `users`: a user's dimensions and how many users have them. `rows`: how many
    `members` has at most, if known. `names`: what the numbers in the `cell` of `members`, if it has
    one, stand for.
    """

    cells: DataFrame
    members: DataFrame
    users: DataFrame
    age_bins: Bins
    rows: int | None = None
    names: CellNames | None = None

    def kept(self) -> RevenueCube:
        """The cube written once to the folder of spark.checkpoint.dir, and read from there."""
        own = self.members.drop(*DIMENSIONS) if self.names else self.members
        found = []
        for df in (self.cells, own, self.users):
            found.append(keep(df, codec=CODEC))
            free_shuffles(df.sparkSession)
        cells, own, users = found
        members = self.names.of(own) if self.names else own
        return RevenueCube(cells, members, users, self.age_bins, own.count(), self.names)

    def chosen(self, filters: Filters) -> RevenueCube:
        """The part of the cube that the filters leave, with the meaning they have for a scope."""
        if filters.age_bins != self.age_bins:
            raise ValueError("the cube has other age groups than the filters")
        choices = {
            "order_month": filters.months,
            "status": filters.statuses,
            "gender": None if filters.gender is None else [filters.gender],
            "age_group": filters.age_groups,
            "traffic_source": filters.traffic_sources,
            "category": filters.categories,
            "brand": filters.brands,
        }

        def cut(df: DataFrame) -> DataFrame:
            for name, values in choices.items():
                if values is not None and name in df.columns:
                    df = df.where(F.col(name).isin(list(values)))
            return df

        parts = map(cut, (self.cells, self.members, self.users))
        return RevenueCube(*parts, self.age_bins, self.rows, self.names)


def _numbered(
    df: DataFrame, columns: Sequence[str], code: str
) -> tuple[DataFrame, DataFrame, int]:
    """The frame with a number in place of the columns, what the numbers stand for, and how many there are."""
    # Written once: the numbers do not change when a task is done again.
    names = df.select(*columns).distinct().withColumn(code, F.monotonically_increasing_id())
    names = keep(names)
    size = 1 + (names.agg(F.max(code)).first()[0] or 0)
    if size <= 1 << 31:
        names = names.withColumn(code, F.col(code).cast("int"))
    same = reduce(and_, (df[c].eqNullSafe(names[c]) for c in columns))
    coded = df.join(names, same).select(*(df[c] for c in df.columns if c not in columns), code)
    return coded, names, size


def _looked_up(df: DataFrame, key: str, codes: DataFrame, code: str) -> DataFrame:
    """The rows whose key has a number in `codes` (`key` and `code`), with the number.

    Numbers stand in rows of 64 ids: as many ids take a fraction of the memory of a row for each, and
    most tables of users or products can go to all tasks.
    """
    word, place = F.shiftright(key, WORD.bit_length() - 1), F.col(key).bitwiseAND(WORD - 1)
    held = F.array(*(F.max(F.when(place == k, F.col(code))) for k in range(WORD)))
    words = codes.where(F.col(key).isNotNull()).groupBy(word.alias("_word")).agg(held.alias("_codes"))
    words = keep(words)
    words = F.broadcast(words) if words.count() <= BROADCAST_WORDS else words
    met = df.withColumn("_word", word).join(words, "_word")
    found = F.get("_codes", place.cast("int"))
    return met.withColumn(code, found).where(F.col(code).isNotNull()).drop("_word", "_codes")


def revenue_cube(
    users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, age_bins: Bins
) -> RevenueCube:
    """The cube over all rows that some choice of filters can keep.

    Unknown statuses, age groups, sources, categories and brands are in no choice's scope and not in
    the cube; unknown genders and order dates are in that of no choice. Ids of users, orders and
    products are taken to be keys, and whole numbers. Items are summed by order and product, with the
    numbers of their dimensions, into a table that is written once; sums and sets are then made in tasks
    of about `ROWS_A_TASK` of its rows, whatever their number.
    """
    spark = items.sparkSession
    of_order, order_names, orders_n = _numbered(
        orders.where("status IS NOT NULL AND order_id IS NOT NULL").select(
            "order_id", F.month("created_at").alias("order_month"), "status"
        ),
        OF_ORDER,
        "of_order",
    )
    known_users = keep(
        users.where(age_bins.within("age") & F.col("traffic_source").isNotNull()).select(
            F.col("id").cast("bigint").alias("user_id"),
            "gender",
            age_bins.name(age_bins.position("age")).alias("age_group"),
            "traffic_source",
        )
    )
    of_user, user_names, users_n = _numbered(known_users, OF_USER, "of_user")
    of_name, product_names, products_n = _numbered(
        products.where("category IS NOT NULL AND brand IS NOT NULL").select(
            F.col("id").cast("bigint").alias("product_id"), "category", "brand", "name"
        ),
        (*OF_PRODUCT, "name"),
        OF_NAME,
    )
    # The number of a category and brand is the least of those with a name.
    least = product_names.groupBy(*OF_PRODUCT).agg(F.min(OF_NAME).alias("of_product"))
    of_product = keep(product_names.join(least, list(OF_PRODUCT)).select(OF_NAME, "of_product"))
    names = CellNames((order_names, user_names, keep(least)), (orders_n, users_n, products_n))

    line = ("order_id", "user_id", "product_id", "month")
    # Joined by order first, the sums need no exchange of their own.
    sold = (
        items.select(
            "order_id",
            *(F.col(c).cast("bigint").alias(c) for c in line[1:3]),
            cal.month_start(F.col("created_at")).alias("month"),
            "sale_price",
        )
        .join(of_order, "order_id")
        .groupBy(*line, "of_order")
        .agg(money().alias("revenue"))
    )
    facts = _looked_up(sold, "product_id", of_name, OF_NAME)
    facts = _looked_up(facts, "user_id", of_user, "of_user").join(of_product, OF_NAME)
    facts = facts.select("order_id", "user_id", names.cell().alias("cell"), OF_NAME, "month", "revenue")
    # In order, so that like cells are neighbours in what is written here and exchanged later.
    facts = keep(facts.sortWithinPartitions("cell"), codec=CODEC)
    free_shuffles(spark)
    tasks = 1 + facts.count() // ROWS_A_TASK

    months = F.struct(F.lit(BY_MONTH).alias("grain"), "month", F.lit(None).alias(OF_NAME))
    by_name = F.struct(F.lit(BY_NAME).alias("grain"), F.lit(None).cast("date").alias("month"), OF_NAME)
    sums = (
        facts.select("cell", "month", OF_NAME, "revenue")
        .repartition(tasks, "cell")
        .select("cell", "revenue", F.inline(F.array(months, by_name)))
        .groupBy("cell", "grain", "month", OF_NAME)
        .agg(money("revenue").alias("revenue"))
    )
    cells = (
        names.of(sums)
        .join(product_names.select(OF_NAME, "name"), OF_NAME, "left")
        .select(*DIMENSIONS, "month", "name", "revenue", "grain")
    )

    def members_by(kind: str, key: str) -> DataFrame:
        id = F.col(key).cast("bigint")
        return (
            facts.select(
                "cell",
                F.bitmap_bucket_number(id).alias("page"),
                F.bitmap_bit_position(id).cast("smallint").alias("bit"),
            )
            .repartition(tasks, "cell", "page")
            .groupBy("cell", "page")
            # a set of at most a page's positions, however many rows a member has
            .agg(F.collect_set("bit").alias("bits"))
            .select("cell", F.lit(kind).alias("kind"), "page", "bits")
        )

    members = names.of(members_by(ORDER, "order_id").unionByName(members_by(BUYER, "user_id")))
    one_each = known_users.where("user_id IS NOT NULL").distinct()
    counted = one_each.groupBy(*OF_USER).agg(F.count("*").alias("total_users"))
    return RevenueCube(cells, members, counted, age_bins, names=names)


def _distinct(
    cube: RevenueCube, kind: str, *keys: str, each: Column | None = None
) -> DataFrame:
    """`members`: how many distinct ids of a kind there are for each of the keys.

    `each`, if given, makes the keys of a row's dimensions, several of them.
    """
    coded = each is not None and cube.names is not None
    dimensions = ("cell",) if coded else DIMENSIONS if each is not None else keys
    word = F.col("page") * (PAGE // WORD) + F.shiftright("bit", WORD.bit_length() - 1)
    rows = (
        cube.members.where(F.col("kind") == kind)
        .select(*dimensions, "page", F.explode("bits").alias("bit"))
        .select(
            *dimensions,
            word.alias("word"),
            F.expr(f"shiftleft(1L, bit % {WORD})").alias("bits"),
        )
    )
    if cube.rows is not None:
        rows = rows.repartition(1 + cube.rows // ROWS_A_TASK, "word")
    if coded:
        rows = cube.names.of(rows)
    if each is not None:
        rows = rows.select("word", "bits", each).where(F.col(keys[-1]).isNotNull())
    words = rows.groupBy(*keys, "word").agg(F.bit_count(F.bit_or("bits")).alias("n"))
    return words.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def _sums(cube: RevenueCube, grain: str, *keys: str | Column) -> DataFrame:
    cells = cube.cells.where(F.col("grain") == grain)
    return cells.groupBy(*keys).agg(money("revenue").alias("revenue"))


def cube_kpis(cube: RevenueCube) -> DataFrame:
    """As `revenue_kpis` of the scope with the same choice."""
    users = cube.users.agg(F.coalesce(F.sum("total_users"), F.lit(0)))
    totals = (
        _sums(cube, BY_MONTH)
        .withColumnRenamed("revenue", "total_revenue")
        .withColumn("total_orders", _distinct(cube, ORDER).scalar())
        .withColumn("purchasing_users", _distinct(cube, BUYER).scalar())
        .withColumn("total_users", users.scalar())
    )
    return with_averages(totals)


def cube_monthly(cube: RevenueCube) -> DataFrame:
    """As `revenue_monthly`."""
    return _sums(cube, BY_MONTH, "month").where("month IS NOT NULL").orderBy("month")


def cube_category_topk(cube: RevenueCube, k: int = 10) -> DataFrame:
    """As `category_revenue_topk`."""
    return labelled_top(_sums(cube, BY_MONTH, "category"), k, "revenue", "category")


def cube_category_aov_topk(cube: RevenueCube, k: int = 10) -> DataFrame:
    """As `category_aov_topk`."""
    sums = _sums(cube, BY_MONTH, "category")
    aov = sums.join(_distinct(cube, ORDER, "category"), "category").select(
        "category", ratio(F.col("revenue"), F.col("members")).alias("aov")
    )
    return labelled_top(aov.where("aov IS NOT NULL"), k, "aov", "category")


def cube_product_topk(cube: RevenueCube, k: int = 10) -> DataFrame:
    """As `product_revenue_topk`."""
    named = _sums(cube, BY_NAME, "name").where("name IS NOT NULL")
    return labelled_top(named, k, "revenue", "name")


def cube_by_value(cube: RevenueCube, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """`dimension, value, revenue, orders, buyers`: a row for each known value of each dimension."""
    each = F.inline(
        F.array(
            *(
                F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                for d in dimensions
            )
        )
    )
    keys = ("dimension", "value")
    sums = (
        cube.cells.where(F.col("grain") == BY_MONTH)
        .select("revenue", each)
        .groupBy(*keys)
        .agg(money("revenue").alias("revenue"))
    )
    orders = _distinct(cube, ORDER, *keys, each=each).withColumnRenamed("members", "orders")
    buyers = _distinct(cube, BUYER, *keys, each=each).withColumnRenamed("members", "buyers")
    return sums.join(orders, list(keys)).join(buyers, list(keys))
