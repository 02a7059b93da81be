"""What happens inside one page: claims of tables on blocks, absorption, places in reading order, Markdown.

Claims depend on what earlier tables and images took, so a page is one row: its tables, blocks and images as
arrays in order, shuffled once on (doc, page).  Each operator is a fold over that row by built-in array
functions; a page's handful of boxes bounds the row, and pages never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KEY = ["doc", "page"]
LEAST_OVERLAP, MARGIN, LEAST_ACROSS = 0.35, 2.0, 0.15
PROTECTED = ("title", "section_header", "caption")
IMAGE_TEXT = ("text", "list_item", "document_index")
BOX = list(G.Box._fields)
INTS = "array<int>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def unless(values: Column, taken: Column, at=lambda x: x["ord"]) -> Column:
    """Items of ``values`` whose place is not in ``taken``."""
    return F.filter(values, lambda x: ~F.array_contains(taken, at(x)))


def box_of(x: Column) -> G.Box:
    return G.Box(*(x[n] for n in BOX))


def _items(rows: DataFrame, name: str, order: list[str], more: list[str]) -> DataFrame:
    return rows.select(*KEY, F.struct(*order, *(F.col(c).cast("double").alias(c) for c in BOX), *more).alias(name))


def _grouped(rows: DataFrame, name: str, order: list[str], more: list[str]) -> DataFrame:
    return _items(rows, name, order, more).groupBy(*KEY).agg(F.sort_array(F.collect_list(name)).alias(name))


def rows_of(frame: DataFrame, array: Column | str, *names: str) -> DataFrame:
    """KEY and the items of an array (fields ``names``, else all; with its place as ``n`` if asked for), one a row.

    Outer, as else the optimiser asks for the array's size below and works out twice more what made it."""
    if "n" in names:
        each = frame.select(*KEY, F.posexplode_outer(array).alias("n", "x"))
    else:
        each = frame.select(*KEY, F.explode_outer(array).alias("x"))
    return each.where(F.col("x").isNotNull()).select(*KEY, *(c if c == "n" else f"x.{c}" for c in names or ["*"]))


def page_frame(tables: DataFrame, blocks: DataFrame, images: DataFrame | None = None, *more: str, how: str = "full_outer", told: tuple[str, ...] = (), reach: DataFrame | None = None) -> DataFrame:
    """doc, page, tables, blocks, images: every page that has any, each array in order.

    ``tables``: doc, page, k (order on the page), id and a box; ``blocks``: doc, page, ord, kind, a box that may be
    null, and columns ``more``; ``images``: see page_markdown.  Each table has offers, one for each block that it
    overlaps or whose centre it holds: few blocks are near a table, and only those are weighed.  With ``how`` left,
    pages without tables are left out, and all rows stay where the tables are.  Tables keep columns ``told``;
    ``reach``, from lineage.reached(), joins blocks before tables do, as an outer join's rows would be dealt anew."""
    placed = _grouped(blocks, "blocks", ["ord", "kind"], list(more))
    if reach is not None:
        placed = placed.join(reach, KEY, "left")
    frame = _grouped(tables, "tables", ["k", "id"], list(told)).join(placed, KEY, how)
    if images is not None:
        frame = frame.join(_grouped(images, "images", ["pos", "id"], ["block", "caption", "included", "slot", "text"]), KEY, how)
    lists = [c for c in frame.columns if c not in KEY]
    frame = frame.select(*KEY, *(F.coalesce(c, none_of(frame.schema[c].dataType.simpleString())).alias(c) for c in lists))

    def near(a: Column, b: Column) -> Column:
        """Whether boxes meet within the margin, so that all others neither overlap nor hold a centre."""
        meet = lambda low, high: (F.least(b[low], b[high]) <= a[high] + MARGIN) & (F.greatest(b[low], b[high]) >= a[low] - MARGIN)
        return meet("top", "bottom") & meet("x0", "x1")

    def offer(a: Column, b: Column) -> Column:
        score, inside = G.overlap(box_of(a), box_of(b)), G.contains_center(box_of(a), box_of(b), MARGIN)
        return F.struct(b["ord"].alias("ord"), b["kind"].alias("kind"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(inside, F.lit(False)).alias("inside"))

    offers = lambda t, blocks_: F.transform(F.filter(blocks_, lambda b: near(t, b)), lambda b: offer(t, b))
    listed = let(F.struct("tables", "blocks"), lambda x: F.transform(x["tables"], lambda t: t.withField("offers", offers(t, x["blocks"]))))
    return frame.select(*KEY, listed.alias("tables"), *(c for c in lists if c != "tables"))


def best(offers: Column) -> Column:
    """(s, ord): the offer of largest overlap, its score negated; the first block of equal ones; null if none overlaps."""
    rivals = F.filter(offers, lambda o: (o["kind"] == "table") & (o["score"] > 0))
    return F.array_min(F.transform(rivals, lambda o: F.struct((-o["score"]).alias("s"), o["ord"].alias("ord"))))


def won(found: Column, least: float = LEAST_OVERLAP) -> Column:
    return F.when(-found["s"] >= least, found["ord"])


def best_match(frame: DataFrame, kind: str = "table", least: float = LEAST_OVERLAP) -> DataFrame:
    """doc, page, id, k, ord, score: tables claim, in order, the free block of ``kind`` that they overlap most.

    A table whose best remaining overlap is below ``least`` claims nothing (ord null) but reports it."""
    out = none_of("array<struct<id:bigint,k:int,ord:int,score:double>>")
    start = F.struct(none_of(INTS).alias("used"), out.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        rivals = F.transform(F.filter(t["offers"], lambda o: o["kind"] == kind), lambda o: o.withField("kind", F.lit("table")))
        return let(best(unless(rivals, acc["used"])), lambda b: F.struct(
            F.concat(acc["used"], F.array_compact(F.array(won(b, least)))).alias("used"),
            F.array_append(acc["out"], F.struct(t["id"].cast("bigint").alias("id"), t["k"].cast("int").alias("k"), won(b, least).alias("ord"), F.coalesce(-b["s"], F.lit(0.0)).alias("score"))).alias("out"),
        ))

    return rows_of(frame, F.aggregate("tables", start, step)["out"])


def direct_relations(frame: DataFrame) -> DataFrame:
    """doc, page, id, ord, method, overlap, n: blocks that tables claim, in the order of claims n."""
    return rows_of(frame, claims(F.col("tables")), "id", "ord", "method", "overlap", "n")


def claims(tables: Column) -> Column:
    """(id, ord, method, overlap) of a page's claims in order.

    Each table in turn claims the free table block that it overlaps most, then all free ones whose centre
    it holds; what it took is gone for the next."""
    kind = "array<struct<id:bigint,ord:int,method:string,overlap:double>>"
    start = F.struct(none_of(INTS).alias("used"), none_of(kind).alias("out"))

    def claim(t, ord_, method, score):
        return F.struct(t["id"].cast("bigint").alias("id"), ord_.alias("ord"), F.lit(method).alias("method"), F.bround(score, 4).alias("overlap"))

    def step(acc: Column, t: Column) -> Column:
        free = unless(F.filter(t["offers"], lambda o: o["kind"] == "table"), acc["used"])

        def both(b: Column) -> Column:
            first = F.when(won(b).isNotNull(), F.array(claim(t, won(b), "bbox_overlap", -b["s"]))).otherwise(none_of(kind))
            rest = F.filter(free, lambda o: o["inside"] & (o["ord"] != F.coalesce(won(b), F.lit(-1))))
            return F.concat(first, F.transform(rest, lambda o: claim(t, o["ord"], "bbox_contains_center", o["score"])))

        return let(let(best(free), both), lambda now: F.struct(F.concat(acc["used"], F.transform(now, lambda x: x["ord"])).alias("used"), F.concat(acc["out"], now).alias("out")))

    return F.aggregate(tables, start, step)["out"]


def slot_of(t: Column, blocks: Column, absorbed: Column) -> Column:
    """Where a table without a match goes: its first absorbed block's place; else half a step after the nearest
    block above that shares some of its width; else half a step before the page's first block."""
    a = box_of(t)

    def over(b: Column) -> Column:
        o = box_of(b)
        return F.coalesce((o.bottom <= a.top + 2) & (G.horizontal_overlap(a, o) >= LEAST_ACROSS), F.lit(False))

    above = F.array_min(F.transform(F.filter(blocks, over), lambda b: F.struct((a.top - b["bottom"]).alias("gap"), b["ord"].alias("ord"))))
    start = F.coalesce(F.array_min(F.transform(blocks, lambda b: b["ord"])), F.lit(0)) - 0.5
    return F.coalesce(F.array_min(F.transform(absorbed, lambda o: o["ord"])).cast("double"), above["ord"] + 0.5, start)


def merges(frame: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``frame`` with merges and gone: what becomes of each table, and the blocks that are shown no more.

    A merge has id, k, matched, overlap, absorbed, action, source_slot and slot.  In order, a table matches the
    free table block that it overlaps most and absorbs all unprotected blocks whose centre it holds and
    nothing took yet (``gone``: doc, page, ord of blocks taken before; or the frame has them as list ``before``).
    Places are then dealt anew, so that tables of a page never swap."""
    if gone is not None:
        before = gone.groupBy(*KEY).agg(F.collect_set(F.col("ord").cast("int")).alias("before"))
        frame = frame.join(before, KEY, "left").withColumn("before", F.coalesce("before", none_of(INTS)))
    elif "before" not in frame.columns:
        frame = frame.withColumn("before", none_of(INTS))
    kind = "array<struct<id:bigint,k:int,matched:int,overlap:double,absorbed:array<int>,action:string,source_slot:double>>"

    def step(page: Column, acc: Column, t: Column) -> Column:
        def taken(b: Column) -> Column:
            inside = F.filter(t["offers"], lambda o: o["inside"] & ~o["kind"].isin(*PROTECTED))
            return F.struct(b["s"].alias("s"), won(b).alias("matched"), unless(unless(inside, acc["used"]), acc["gone"]).alias("absorbed"))

        def next_(x: Column) -> Column:
            orders = F.transform(x["absorbed"], lambda o: o["ord"])
            tables = F.transform(F.filter(x["absorbed"], lambda o: o["kind"] == "table"), lambda o: o["ord"])
            match = F.array_compact(F.array(x["matched"]))
            action = F.when(x["matched"].isNotNull(), "replaced_layout_table").when(F.size(orders) > 0, "replaced_text_fragments").otherwise("inserted_missing_table")
            merge = F.struct(
                t["id"].cast("bigint").alias("id"), t["k"].cast("int").alias("k"), x["matched"].alias("matched"), F.bround(F.coalesce(-x["s"], F.lit(0.0)), 4).alias("overlap"), orders.alias("absorbed"),
                action.alias("action"), F.coalesce(x["matched"].cast("double"), slot_of(t, page["blocks"], x["absorbed"])).alias("source_slot"),
            )
            return F.struct(F.concat(acc["used"], match, tables).alias("used"), F.concat(acc["gone"], match, orders).alias("gone"), F.array_append(acc["out"], merge).alias("out"))

        return let(let(best(unless(t["offers"], acc["used"])), taken), next_)

    def placed(fold: Column) -> Column:
        slots = F.sort_array(F.transform(fold["out"], lambda x: x["source_slot"]))
        out = let(slots, lambda sorted_: F.transform(fold["out"], lambda x, i: x.withField("slot", F.get(sorted_, i))))
        return F.struct(out.alias("merges"), fold["gone"].alias("gone"))

    def fold(page: Column) -> Column:
        start = F.struct(none_of(INTS).alias("used"), page["before"].alias("gone"), none_of(kind).alias("out"))
        return let(F.aggregate(page["tables"], start, lambda acc, t: step(page, acc, t)), placed)

    # a page is one value: its lists would be sorted again for each table that reads them
    out = frame.withColumn("fold", let(F.struct("tables", "blocks", "before"), fold))
    return out.select(*(c for c in frame.columns if c != "before"), "fold.merges", "fold.gone")


def absorbed_blocks(merged: DataFrame) -> DataFrame:
    """doc, page, ord, id: blocks that tables absorb, from merges()."""
    each = F.flatten(F.transform("merges", lambda m: F.transform(m["absorbed"], lambda o: F.struct(o.alias("ord"), m["id"].alias("id")))))
    return rows_of(merged, each)


def with_images(merged: DataFrame) -> DataFrame:
    """``merged`` with image_merges (image, absorbed), and gone extended: images in order absorb running text whose
    centre they hold and nothing took yet, but for the block that they stand for; hidden ones absorb nothing,
    and so do those without a box."""
    kind = "array<struct<image:string,absorbed:array<int>>>"

    def step(page: Column, acc: Column, image: Column) -> Column:
        held = F.filter(page["texts"], lambda b: F.coalesce(G.contains_center(box_of(image), box_of(b), MARGIN), F.lit(False)))
        free = F.transform(unless(F.filter(held, lambda b: b["ord"] != F.coalesce(image["block"], F.lit(-1))), acc["gone"]), lambda b: b["ord"])
        return let(F.when(image["included"], free).otherwise(none_of(INTS)), lambda now: F.struct(
            F.concat(acc["gone"], now).alias("gone"),
            F.when(F.size(now) > 0, F.array_append(acc["out"], F.struct(image["id"].cast("string").alias("image"), now.alias("absorbed")))).otherwise(acc["out"]).alias("out"),
        ))

    # an image that a table absorbed is shown no more; what lambdas read is worked out once, outside of them
    taken = lambda x: F.flatten(F.transform(x["merges"], lambda m: m["absorbed"]))
    shown = lambda x: let(taken(x), lambda t: F.transform(x["images"], lambda i: i.withField("included", i["included"] & ~F.coalesce(F.array_contains(t, i["block"]), F.lit(False)))))
    texts = lambda x: F.filter(x["blocks"], lambda b: b["kind"].isin(*IMAGE_TEXT))

    def fold(page: Column) -> Column:
        start = F.struct(page["gone"].alias("gone"), none_of(kind).alias("out"))
        return F.struct(page["images"].alias("images"), F.aggregate(page["images"], start, lambda acc, i: step(page, acc, i)).alias("fold"))

    folded = let(F.struct("merges", "images", "blocks", "gone"), lambda x: let(F.struct(shown(x).alias("images"), texts(x).alias("texts"), x["gone"].alias("gone")), fold))
    out = merged.withColumn("x", folded)
    rest = [c for c in merged.columns if c not in ("gone", "images")]
    return out.select(*rest, F.col("x.images").alias("images"), F.col("x.fold.gone").alias("gone"), F.col("x.fold.out").alias("image_merges"))


def contained_captions(blocks: DataFrame, normal) -> DataFrame:
    """doc, page, ord, other, kind: captions whose normalised text stands in a table's or a picture's of their page."""
    text = normal(F.col("markdown"))
    captions = blocks.where("kind = 'caption'").select(*KEY, "ord", text.alias("said")).where("said <> ''")
    hosts = blocks.where(F.col("kind").isin("table", "picture")).select(*KEY, F.col("ord").alias("other"), "kind", text.alias("whole"))
    return captions.join(hosts, KEY).where(F.contains("whole", "said")).select(*KEY, "ord", "other", "kind")


def held_captions(frame: DataFrame) -> DataFrame:
    """``frame``, whose blocks have markdown and said (their normalised text; of captions, tables and pictures at
    least), with claimed (places of blocks that tables claim) and contained (ord, markdown, other, kind: captions
    whose text stands in a table's or a picture's).  The same as contained_captions() inside of one row."""

    def pairs(blocks: Column) -> Column:
        said = F.filter(blocks, lambda b: (b["kind"] == "caption") & (b["said"] != ""))
        hosts = F.filter(blocks, lambda b: b["kind"].isin("table", "picture"))
        pair = lambda c, h: F.struct(c["ord"].alias("ord"), c["markdown"].alias("markdown"), h["ord"].alias("other"), h["kind"].alias("kind"))
        of = lambda c, hosts_: F.transform(F.filter(hosts_, lambda h: F.contains(h["said"], c["said"])), lambda h: pair(c, h))
        return let(F.struct(said.alias("said"), hosts.alias("hosts")), lambda x: F.flatten(F.transform(x["said"], lambda c: of(c, x["hosts"]))))

    page = lambda x: F.struct(F.transform(claims(x["tables"]), lambda c: c["ord"]).alias("claimed"), pairs(x["blocks"]).alias("contained"))
    return frame.withColumn("held", let(F.struct("tables", "blocks"), page)).select(*frame.columns, "held.claimed", "held.contained")


def hidden_before(contained: Column, images: Column, continued: Column) -> Column:
    """Places of a page's blocks that are gone before tables claim, as hidden_before_tables() gives them."""
    ignored = F.filter(images, lambda i: ~i["included"] & i["block"].isNotNull())
    spoken = F.filter(images, lambda i: i["included"] & i["block"].isNotNull() & i["caption"].isNotNull())
    lists = F.transform(contained, lambda c: c["ord"]), F.transform(ignored, lambda i: i["block"]), F.transform(spoken, lambda i: i["caption"]), continued
    return F.array_distinct(F.concat(*(x.cast(INTS) for x in lists)))


def hidden_before_tables(blocks: DataFrame, images: DataFrame, continued: DataFrame, normal) -> DataFrame:
    """doc, page, ord of blocks that are gone before tables claim: contained captions, pictures that are ignored,
    tables that continue one of an earlier page, and captions of shown images."""
    ignored = images.where(~F.col("included") & F.col("block").isNotNull()).select(*KEY, F.col("block").alias("ord"))
    spoken = images.where(F.col("included") & F.col("block").isNotNull() & F.col("caption").isNotNull()).select(*KEY, F.col("caption").alias("ord"))
    every = contained_captions(blocks, normal).select(*KEY, "ord").unionByName(ignored).unionByName(spoken).unionByName(continued.select(*KEY, "ord"))
    return every.distinct()


def page_markdown(frame: DataFrame, texts: DataFrame | None = None, headings: DataFrame | None = None) -> DataFrame:
    """doc, page, markdown of pages from with_images(), whose blocks have markdown.

    At one place tables come first, then images that stand for no block, then blocks.  Images: pos, id, block (the
    block they stand for, or null), caption, included, slot, text (their Markdown).  ``texts``: doc, page, id,
    markdown, last_page of tables on their first page; ``headings``: doc, page, ord, heading of numbered captions that precede the
    table that replaces block ord.  Without them they are read from the frame: markdown and last_page of its tables,
    and its list headings (ord, heading), if it has one."""
    own = lambda t: F.struct(t["id"].cast("bigint").alias("id"), F.struct(t["markdown"].alias("markdown"), t["last_page"].alias("last_page")).alias("x"))
    if texts is not None:
        named = texts.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("bigint"), F.struct("markdown", "last_page")))).alias("texts"))
        out = frame.join(named, KEY, "left")
    else:
        out = frame.withColumn("texts", F.map_from_entries(F.transform("tables", own)))
    if headings is None and "headings" in frame.columns:
        out = out.withColumn("headings", F.map_from_entries(F.transform("headings", lambda h: F.struct(h["ord"], h["heading"]))))
    elif headings is not None:
        said = headings.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ord").cast("int"), "heading"))).alias("headings"))
        out = out.join(said, KEY, "left")
    else:
        out = out.withColumn("headings", F.lit(None).cast("map<int,string>"))

    def entry(at, rank, text):
        return F.struct(at.cast("double").alias("at"), rank.cast("int").alias("rank"), text.alias("text"))

    def table_entry(x: Column, m: Column, i: Column) -> Column:
        own = F.try_element_at(x["texts"], m["id"])
        title = F.try_element_at(x["headings"], m["matched"])
        marked = table_block(m["id"].cast("string"), F.col("page"), F.coalesce(own["last_page"], F.col("page")), F.trim(F.coalesce(own["markdown"], F.lit(""))), title)
        return entry(m["slot"], i, marked)

    def every(x: Column) -> Column:
        def block_text(b: Column) -> Column:
            images = F.filter(x["images"], lambda i: i["included"] & (i["block"] == b["ord"]))
            return F.trim(F.coalesce(F.try_element_at(images, F.lit(-1))["text"], b["markdown"], F.lit("")))

        tables = F.transform(x["merges"], lambda m, i: table_entry(x, m, i))
        free = F.filter(x["images"], lambda i: i["block"].isNull())
        shown = F.filter(F.transform(free, lambda i, n: F.struct(i["included"].alias("yes"), entry(F.coalesce(i["slot"], F.lit(0.0)), n + 500, i["text"]).alias("e"))), lambda i: i["yes"])
        blocks = F.filter(F.transform(unless(x["blocks"], x["gone"]), lambda b: entry(b["ord"], F.lit(1000), block_text(b))), lambda e: e["text"] != "")
        return F.sort_array(F.concat(tables, F.transform(shown, lambda i: i["e"]), blocks))

    # one struct, worked out once for a page
    entries = let(F.struct("merges", "images", "blocks", "gone", "texts", "headings"), every)
    body = F.array_join(F.transform(entries, lambda e: e["text"]), "\n\n")
    text = F.rtrim(F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->\n\n"), body), F.lit(" \n\t\r"))
    return out.select(*KEY, text.alias("markdown"))


def table_block(id_: Column, page: Column, last: Column, text: Column, heading: Column | None = None) -> Column:
    """A table between its markers; the closing one names its last page.  A heading goes before."""
    block = F.concat(F.format_string("<!-- table:%s page:%s -->\n\n", id_, page.cast("string")), text, F.format_string("\n\n<!-- /table:%s page:%s -->", id_, last.cast("string")))
    return block if heading is None else F.concat_ws("\n\n", F.when(heading.isNotNull(), F.concat(F.lit("### "), heading)), block)


def documents(pages: DataFrame) -> DataFrame:
    """doc, markdown: pages in order with a rule between, one line break at the end."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n\n---\n\n")
    return pages.groupBy("doc").agg(F.concat(F.rtrim(text), F.lit("\n")).alias("markdown"))


def captions(blocks: DataFrame, gap: float = 55.0) -> DataFrame:
    """doc, page, ord, caption: for each picture the nearest caption below it that shares some of its width."""
    pictures, texts = blocks.where("kind = 'picture'"), blocks.where("kind = 'caption'")
    c = texts.select(*KEY, *(F.col(n).alias(f"c_{n}") for n in ("ord", "x0", "x1", "top")))
    near = pictures.join(c, KEY).where((F.col("c_top") >= F.col("bottom") - 2) & (F.col("c_top") - F.col("bottom") <= gap))
    near = near.where(F.least("x1", "c_x1") > F.greatest("x0", "c_x0"))
    found = near.groupBy(*KEY, "ord").agg(F.min(F.struct((F.col("c_top") - F.col("bottom")).alias("far"), "c_ord")).alias("x"))
    return pictures.select(*KEY, "ord").join(found.select(*KEY, "ord", F.col("x.c_ord").alias("caption")), [*KEY, "ord"], "left")


def caption_below(picture: Column, captions: Column, gap: float = 55.0) -> Column:
    """The caption that captions() gives a picture, among those of its page."""
    near = lambda c: (c["top"] >= picture["bottom"] - 2) & (c["top"] - picture["bottom"] <= gap) & (F.least(picture["x1"], c["x1"]) > F.greatest(picture["x0"], c["x0"]))
    return F.array_min(F.transform(F.filter(captions, near), lambda c: F.struct((c["top"] - picture["bottom"]).alias("far"), c["ord"].alias("ord"))))["ord"]


def image_slot(image: Column, blocks: Column) -> Column:
    """The place that image_slots() gives an image, among all blocks of its page."""
    above = F.array_max(F.transform(F.filter(blocks, lambda b: b["bottom"] <= image["top"] + 2), lambda b: F.struct(b["bottom"].alias("end"), (-b["ord"]).alias("o"))))
    return F.coalesce(0.5 - above["o"], F.array_min(F.transform(blocks, lambda b: b["ord"])) - 0.5, F.lit(-0.5)).cast("double")


def image_slots(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, page, id, slot: half a step after the block that ends lowest above an image, whatever its width; else
    half a step before the page's first block (-0.5 on a page without blocks)."""
    b = blocks.select(*KEY, "ord", F.col("bottom").alias("end"))
    above = images.join(b, KEY).where(F.col("end") <= F.col("top") + 2).groupBy(*KEY, "id").agg(F.max(F.struct("end", (-F.col("ord")).alias("o"))).alias("x"))
    start = blocks.groupBy(*KEY).agg(F.min("ord").alias("first"))
    out = images.select(*KEY, "id").join(above, [*KEY, "id"], "left").join(start, KEY, "left")
    return out.select(*KEY, "id", F.coalesce(0.5 - F.col("x.o"), F.col("first") - 0.5, F.lit(-0.5)).cast("double").alias("slot"))


def match_images(seen: DataFrame, pictures: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """doc, page, image, action, picture, score: what becomes of each seen image, and of pictures merged into one.

    ``seen``: doc, page, image (order), a box, ids (pictures it names); ``pictures``: doc, page, picture, ord and a
    box.  In order: exactly one free picture named takes the image ("matched"); several are "merged" into a new
    image; else the free picture of largest overlap, from ``least`` on; else the image is "new"."""
    a = _grouped(seen, "seen", ["image"], ["ids"])
    b = _grouped(pictures, "pictures", ["ord", "picture"], [])
    frame = a.join(b, KEY, "left").withColumn("pictures", F.coalesce("pictures", none_of(b.schema["pictures"].dataType.simpleString())))
    kind = "array<struct<image:int,action:string,picture:string,score:double>>"
    start = F.struct(none_of("array<string>").alias("used"), none_of(kind).alias("out"))

    def row(image, action, picture, score):
        return F.struct(image["image"].cast("int").alias("image"), F.lit(action).alias("action"), picture.cast("string").alias("picture"), score.cast("double").alias("score"))

    def step(acc: Column, x: Column) -> Column:
        free = F.transform(unless(F.col("pictures"), acc["used"], lambda p: p["picture"]), lambda p: F.struct((-G.overlap(box_of(x), box_of(p))).alias("s"), p["ord"].alias("ord"), p["picture"].alias("picture")))

        def decide(f: Column) -> Column:
            named = F.filter(f, lambda p: F.coalesce(F.array_contains(x["ids"], p["picture"]), F.lit(False)))
            top = F.array_min(f)
            one = F.when(F.size(named) == 1, F.get(named, F.lit(0))).when((F.size(named) == 0) & (-top["s"] >= least), top)
            fresh = F.array(row(x, "new", F.lit(None), F.when(F.size(named) > 1, 0.0).otherwise(F.coalesce(-top["s"], F.lit(0.0)))))
            several = F.concat(F.transform(named, lambda p: row(x, "merged", p["picture"], -p["s"])), fresh)
            now = F.when(F.size(named) > 1, several).when(one.isNotNull(), F.array(row(x, "matched", one["picture"], -one["s"]))).otherwise(fresh)
            return F.struct(F.concat(acc["used"], F.array_compact(F.transform(now, lambda r: r["picture"]))).alias("used"), F.concat(acc["out"], now).alias("out"))

        return let(free, decide)

    return rows_of(frame, F.aggregate("seen", start, step)["out"])


def next_image_index(images: DataFrame) -> DataFrame:
    """doc, next: one more than the largest number of ids like image-0001; 1 if there is none."""
    number = F.regexp_extract("id", r"^image-(\d+)$", 1)
    return images.groupBy("doc").agg((F.coalesce(F.max(F.nullif(number, F.lit("")).cast("long")), F.lit(0)) + 1).alias("next"))
