"""Queries over the driver's tables, by name, and the SQL that says the same.

The tables hold no images, so they stand in: an order is a sheet and a line item a box or a pixel
on it, an embedding a colour vector, an event a point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import strips
from glyphmill.operators import catalog, detection, geometry, naming, outlines, pixels, runs, settings, sheets, vector
from glyphmill.plans.session import streamed, written

c = F.col
CANVAS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's boxes; n, p, s tell boxes of a sheet apart."""
    whole = lambda e: F.expr(f"cast({e} as int)")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("sheet"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_extendedprice").alias("e"),
        whole("l_partkey % 1000").alias("x"), whole("l_suppkey * 7 % 900").alias("y"), whole("l_quantity").alias("w"), (whole("l_quantity") + c("l_linenumber")).alias("h"),
    )


TIES = ["n", "p", "s", "e"]
BOXES = """box as (select l_orderkey sheet, l_linenumber n, l_partkey p, l_suppkey s, l_extendedprice e, cast(l_partkey % 1000 as int) x, cast(l_suppkey * 7 % 900 as int) y,
  cast(trunc(l_quantity) as int) w, cast(trunc(l_quantity) as int) + l_linenumber h from lineitem)"""


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("grp"), c("l_orderkey").alias("sheet"), F.expr("cast(l_partkey % 256 as int)").alias("r"), F.expr("cast(l_suppkey % 256 as int)").alias("g"), (c("l_linenumber") * 30).alias("b"), F.when(c("l_linestatus") == "O", 0).otherwise(255).alias("alpha"))


PIXELS = """pix as (select l_returnflag grp, l_orderkey sheet, cast(l_partkey % 256 as int) r, cast(l_suppkey % 256 as int) g, l_linenumber * 30 b, case when l_linestatus = 'O' then 0 else 255 end alpha from lineitem)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- geometry ----------------------------------------------------------------------------------


SCALED = f"""{BOXES}, sc as (select *, least({CANVAS}.0::double / greatest(1, max(w) over (partition by sheet)), {CANVAS}.0::double / greatest(1, max(h) over (partition by sheet))) scale from box)"""
PLACED = f"""{SCALED}, sz as (select *, case when abs(scale - 1) > 1e-6 then greatest(1, cast(round_even(w * scale, 0) as bigint)) else w end new_w,
  case when abs(scale - 1) > 1e-6 then greatest(1, cast(round_even(h * scale, 0) as bigint)) else h end new_h from sc),
  pl as (select *, cast(floor(({CANVAS} - new_w) / 2.0) as bigint) off_x, cast(floor(({CANVAS} - new_h) / 2.0) as bigint) off_y from sz)"""


@query(f"with {PLACED} select sheet, cast(icon_index as int) icon_index, printf('icon_%03d', icon_index) stem, x, y, w, h, round(scale, 9) scale, new_w, new_h, off_x, off_y, (off_x < 0 or off_y < 0) clipped from (select *, row_number() over (partition by sheet order by y + h / 2.0, x, n, p, s, e) icon_index from pl)")
def icon_manifest(spark, sf_dir):
    """Index, stem, scale and placement of every box: one shuffle, by sheet."""
    df = geometry.uniform_scale(geometry.vector_order(boxes(spark, sf_dir), "sheet", TIES), "sheet", CANVAS, CANVAS)
    df = geometry.place_on_canvas(df, CANVAS, CANVAS)
    return df.select("sheet", "icon_index", geometry.stem(c("icon_index")).alias("stem"), "x", "y", "w", "h", F.round("scale", 9).alias("scale"), "new_w", "new_h", "off_x", "off_y", "clipped")


@query(f"with {BOXES} select sheet, n, p, greatest(0, x - 12) x, greatest(0, y - 12) y, least(1000, x + w + 12) - greatest(0, x - 12) w, least(900, y + h + 12) - greatest(0, y - 12) h from box")
def pad_clamp(spark, sf_dir):
    return geometry.pad_clamp(boxes(spark, sf_dir), 12, F.lit(1000), F.lit(900)).select("sheet", "n", "p", "x", "y", "w", "h")


@query(f"with {BOXES} select sheet, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from box group by sheet")
def box_union(spark, sf_dir):
    return geometry.box_union(boxes(spark, sf_dir), ["sheet"])


@query(f"with {BOXES} select sheet, n, p, w * h area from box where w * h >= 1200")
def area_filter(spark, sf_dir):
    return geometry.area_filter(boxes(spark, sf_dir).withColumn("area", c("w") * c("h")), 1200).select("sheet", "n", "p", "area")


@query(f"with {SCALED} select distinct sheet, round(scale, 9) scale from sc")
def uniform_scale(spark, sf_dir):
    return geometry.uniform_scale(boxes(spark, sf_dir), "sheet", CANVAS, CANVAS).select("sheet", F.round("scale", 9).alias("scale")).distinct()


@query(f"with {SCALED} select sheet, n, p, s, round(case n % 3 when 0 then 1.0 when 1 then scale else least(512.0::double / greatest(1, w), 512.0::double / greatest(1, h)) end, 9) scale from sc")
def scale_choice(spark, sf_dir):
    mode = F.when(c("n") % 3 == 0, "original").when(c("n") % 3 == 1, "uniform_to_largest").otherwise("individual_fit")
    df = geometry.uniform_scale(boxes(spark, sf_dir), "sheet", CANVAS, CANVAS)
    return df.select("sheet", "n", "p", "s", F.round(geometry.scale_for(mode, CANVAS, CANVAS, c("scale")), 9).alias("scale"))


@query(f"with {BOXES} select sheet, n, p, s, cast(row_number() over (partition by sheet order by y + h / 2.0, x, n, p, s, e) as int) icon_index from box")
def vector_order(spark, sf_dir):
    return geometry.vector_order(boxes(spark, sf_dir), "sheet", TIES).select("sheet", "n", "p", "s", "icon_index")


@query(f"""with recursive {BOXES}, sorted as materialized (select sheet, n, p, s, x, cast(y + h / 2.0 as double) cy, row_number() over (partition by sheet order by y + h / 2.0, y, x, n, p, s, e) k from box),
  med as materialized (select sheet, greatest(20, floor(list_sort(list(h))[len(list(h)) // 2 + 1] * 0.75::double)) tol from box group by sheet),
  fold as (select sheet, k, [{{'total': cy, 'n': 1}}] lines, 1::bigint line from sorted where k = 1
    union all select sheet, k, case when fit > 0 then list_transform(lines, lambda l, i: case when i = fit then {{'total': l.total + cy, 'n': l.n + 1}} else l end) else list_append(lines, {{'total': cy, 'n': 1}}) end,
      case when fit > 0 then fit else len(lines) + 1 end
    from (select b.sheet, b.k, b.cy, f.lines, coalesce(list_position(list_transform(f.lines, lambda l: abs(b.cy - l.total / l.n) <= m.tol), true), 0)::bigint fit
      from fold f join sorted b on b.sheet = f.sheet and b.k = f.k + 1 join med m on m.sheet = b.sheet)),
  last as (select sheet, max_by(lines, k) lines from fold group by sheet),
  means as (select sheet, unnest(range(1, len(lines) + 1)) line, unnest(list_transform(lines, lambda l: l.total / l.n)) mean from last),
  numbered as (select sheet, line, row_number() over (partition by sheet order by mean, line) row_no from means)
  select sheet, n, p, s, cast(row_no as int) row_no, cast(row_number() over (partition by sheet order by row_no, x, k) as int) icon_index from sorted join fold using (sheet, k) join numbered using (sheet, line)""")
def reading_order(spark, sf_dir):
    return geometry.reading_order(boxes(spark, sf_dir), "sheet", TIES).select("sheet", "n", "p", "s", "row_no", "icon_index")


@query(f"with {SCALED} select sheet, n, p, s, printf('translate(%.4f %.4f) scale(%.6f)', round_even((512 - w * scale) / 2.0, 4), round_even((512 - h * scale) / 2.0, 4), round_even(scale, 6)) transform from sc")
def svg_transform(spark, sf_dir):
    df = geometry.uniform_scale(boxes(spark, sf_dir), "sheet", CANVAS, CANVAS)
    return df.select("sheet", "n", "p", "s", geometry.svg_transform(CANVAS, CANVAS).alias("transform"))


@query(f"with {BOXES} select sheet, n, p, s, cast(floor(10.0 + x * (300.0 / 1000)) as int) x, cast(floor(20.0 + y * (200.0 / 900)) as int) y, cast(greatest(1, ceil(w * (300.0 / 1000))) as int) w, cast(greatest(1, ceil(h * (200.0 / 900))) as int) h from box".replace("300.0", "300.0::double").replace("200.0", "200.0::double").replace("10.0", "10.0::double").replace("20.0 ", "20.0::double "))
def svg_boxes(spark, sf_dir):
    view = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(300.0).alias("w"), F.lit(200.0).alias("h"))
    return boxes(spark, sf_dir).withColumns(geometry.svg_box(view, F.lit(1000), F.lit(900))).select("sheet", "n", "p", "s", "x", "y", "w", "h")


@query("""with v as (select p_partkey, case p_partkey % 4 when 0 then '0 0 ' || p_size || ' ' || (p_size * 2) when 1 then '0,0,' || p_size || ',7.5' when 2 then 'none' end vb, p_size || 'px' width, case when p_partkey % 3 = 0 then 'auto' else '24' end height from part),
  t as (select *, regexp_split_to_array(trim(translate(vb, ',', ' ')), '\\s+') a from v),
  k as (select *, len(a) = 4 and try_cast(a[1] as double) is not null and try_cast(a[2] as double) is not null and try_cast(a[3] as double) is not null and try_cast(a[4] as double) is not null ok from t)
  select p_partkey, greatest(1.0, case when coalesce(ok, false) then try_cast(a[3] as double) else coalesce(try_cast(replace(width, 'px', '') as double), 0) end)::double canvas_w, greatest(1.0, case when coalesce(ok, false) then try_cast(a[4] as double) else coalesce(try_cast(replace(height, 'px', '') as double), 0) end)::double canvas_h from k""")
def canvas_size(spark, sf_dir):
    k, size = c("p_partkey") % 4, c("p_size").cast("string")
    vb = F.when(k == 0, F.concat(F.lit("0 0 "), size, F.lit(" "), (c("p_size") * 2).cast("string"))).when(k == 1, F.concat(F.lit("0,0,"), size, F.lit(",7.5"))).when(k == 2, "none")
    height = F.when(c("p_partkey") % 3 == 0, "auto").otherwise("24")
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in geometry.canvas_size(vb, F.concat(size, F.lit("px")), height).items()])


GROUPS = f"""{BOXES}, grp as (select sheet, row_number() over (partition by sheet order by n, p, s) group_no, x, y, w, h from box), pt as (select event_id, user_id * 17 % 1000 cx, value * 7 cy from events),
  hit as (select event_id, min(group_no) group_no from pt join grp on sheet = event_id and cx between x - 150 and x + w + 150 and cy between y - 150 and y + h + 150 group by event_id)"""


@query(f"with {GROUPS} select event_id, group_no, case when group_no is null then 's:' || event_id else 'g:' || group_no end group_key from pt left join hit using (event_id)")
def group_assign(spark, sf_dir):
    """Every event is a point on the sheet of its number, held against that sheet's numbered boxes; the padding is wide, as points lie anywhere."""
    from pyspark.sql import Window as W

    numbered = F.row_number().over(W.partitionBy("sheet").orderBy("n", "p", "s")).cast("long")
    groups = boxes(spark, sf_dir).withColumn("group_no", numbered)
    points = table(spark, sf_dir, "events").select(c("event_id").alias("sheet"), "event_id", (c("user_id") * 17 % 1000).alias("cx"), (c("value") * 7).alias("cy"))
    found = geometry.assign_groups(points, groups, 150, point="event_id", group="group_no", keys=("sheet",))
    return geometry.with_singletons(found, point="event_id", group="group_no").select("event_id", "group_no", "group_key")


SHEET_GROUPS = f"""{BOXES}, pt as (select sheet, n, p, s, x + p % 60 - 20 cx, y + s % 50 - 10 cy from box),
  hit as (select pt.sheet, pt.n, pt.p, pt.s, min([b.n, b.p, b.s]) g from pt join box b on b.sheet = pt.sheet and cx between b.x - 3 and b.x + b.w + 3 and cy between b.y - 3 and b.y + b.h + 3 group by all)"""


@query(f"with {SHEET_GROUPS} select sheet, n, p, s, g[1] group_n, g[2] group_p, g[3] group_s, case when g is null then printf('s:{{%d, %d, %d}}', n, p, s) else printf('g:{{%d, %d, %d}}', g[1], g[2], g[3]) end group_key from pt left join hit using (sheet, n, p, s)")
def group_assign_sheets(spark, sf_dir):
    """A point near every box of every sheet, held against the boxes of its sheet; groups are told apart by n, p, s."""
    own = boxes(spark, sf_dir)
    groups = own.withColumn("first", F.struct("n", "p", "s"))
    points = own.select("sheet", F.struct("n", "p", "s").alias("id"), (c("x") + c("p") % 60 - 20).alias("cx"), (c("y") + c("s") % 50 - 10).alias("cy"))
    found = geometry.assign_groups(points, groups, 3, point="id", group="first", keys=("sheet",))
    return geometry.with_singletons(found, point="id", group="first").select("sheet", "id.*", *[c(f"first.{k}").alias(f"group_{k}") for k in ("n", "p", "s")], "group_key")


@query("select p_partkey, case when p_size % 4 = 0 then printf('shape_%04d', cast(row_number() over (partition by p_brand, p_size % 4 = 0 order by p_partkey) as int)) else p_name end elem_id from part")
def auto_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(c("p_size") % 4 == 0, "").otherwise(c("p_name")).alias("elem_id"))
    return geometry.auto_ids(rows, "p_brand", "p_partkey").select("p_partkey", "elem_id")


@query("select p_partkey, case when not (p_size % 3 > 0) then null when p_size % 2 = 1 then 'vector-native-grouped' when p_size % 5 = 0 or p_size > 25 then 'traced-monochrome' else 'embedded-raster-color' end vector_mode, case when p_size > 25 then 'opaque' else 'transparent' end crop, case when p_size > 25 then 'background' else 'clear' end canvas from part")
def vector_modes(spark, sf_dir):
    size = c("p_size")
    mode = geometry.vector_mode(size % 3 > 0, size % 2 == 0, F.when(size % 5 == 0, F.lit(None)).otherwise(size > 25).cast("boolean"))
    source = geometry.bitmap_source(F.when(size > 25, "keep_background").otherwise("transparent_preserve_interior"))
    return table(spark, sf_dir, "part").select("p_partkey", mode.alias("vector_mode"), source["crop"].alias("crop"), source["canvas"].alias("canvas"))


# ---- pixels ------------------------------------------------------------------------------------


@query(f"with {PIXELS}, q as (select grp, r // 16 * 16 r, g // 16 * 16 g, b // 16 * 16 b from pix where alpha > 0), k as (select grp, r, g, b, count(*) n from q group by all) select grp, cast(rank as int) rank, printf('#%02x%02x%02x', r, g, b) colour, n from (select *, row_number() over (partition by grp order by n desc, r desc, g desc, b desc) rank from k) where rank <= 4")
def palette_topk(spark, sf_dir):
    return pixels.palette_counts(pixel_view(spark, sf_dir), ["grp"])


@query(f"with {PIXELS} select sheet, coalesce(max(case when alpha > 0 then greatest(abs(r - g), abs(g - b)) end) <= 60, true) monochrome from pix group by sheet")
def monochrome(spark, sf_dir):
    return pixels.monochrome(pixel_view(spark, sf_dir), ["sheet"], 60)


@query(f"with {PIXELS} select grp, cast(trunc(median(r)) as int) bg_r, cast(trunc(median(g)) as int) bg_g, cast(trunc(median(b)) as int) bg_b from pix group by grp")
def background_median(spark, sf_dir):
    return pixels.background_colour(pixel_view(spark, sf_dir), ["grp"])


@query(f"""with {PIXELS}, k as (select grp, (r + g + b) // 3 level, count(*) n from pix group by all), w as (select *, sum(n) over u below, sum(n * level) over u mass, sum(n) over (partition by grp) al, sum(n * level) over (partition by grp) total from k window u as (partition by grp order by level rows unbounded preceding)),
  z as (select grp, level, round(below::double * (al - below) * (mass / below::double - (total - mass) / (al - below)::double) * (mass / below::double - (total - mass) / (al - below)::double), 3) b from w where below < al)
  select grp, cast(level as int) threshold from (select *, row_number() over (partition by grp order by b desc, level) i from z) where i = 1""")
def otsu_threshold(spark, sf_dir):
    rows = pixel_view(spark, sf_dir).withColumn("gray", F.floor((c("r") + c("g") + c("b")) / 3))
    return pixels.otsu_threshold(rows, ["grp"])


@query("""with b as (select embedding from embeddings where label = 0), m as (select list(a order by i) mean from (select i, avg(v) a from (select unnest(range(1, 65)) i, unnest(embedding)::double v from b) group by i)),
  d as (select vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - mean[i]) * (embedding[i] - mean[i])))) d, abs(embedding[1] - mean[1]) dl, label from embeddings, m),
  t as (select greatest(0.1, quantile_cont(d, 0.95) * 1.02) lim from d where label = 0) select vec_id, round(d, 6) d from d, t where d > lim""")
def mask_threshold(spark, sf_dir):
    """Vectors farther from the mean of a border than nearly all of the border is."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    border = every.where("label = 0")
    limit = pixels.distance_threshold(border, "v").select("mean")
    far = border.crossJoin(F.broadcast(limit)).agg(F.greatest(F.lit(0.1), F.percentile(pixels.distance(c("v"), c("mean")), 0.95) * 1.02).alias("limit"))
    rows = every.crossJoin(F.broadcast(limit)).crossJoin(F.broadcast(far)).withColumn("d", pixels.distance(c("v"), c("mean")))
    return rows.where(c("d") > c("limit")).select("vec_id", F.round("d", 6).alias("d"))


def _morphed(points: DataFrame, key: str, step, kernel, width: int, height: int) -> DataFrame:
    return runs.to_points(runs.morphed(runs.of_points(points, [key]), (width, height), [key], step, kernel), [key])


GRID = "pt as (select distinct l_returnflag grp, cast(l_partkey % 997 as int) x, cast(l_suppkey % 991 as int) y from lineitem)"
OFFSETS = "off as (select * from (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy))"


def grid(spark, sf_dir):
    """Every line item as a point of one of three large grids; some repeat."""
    return table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("grp"), F.expr("cast(l_partkey % 997 as int)").alias("x"), F.expr("cast(l_suppkey % 991 as int)").alias("y")).distinct()


@query(f"with {GRID}, {OFFSETS} select distinct grp, x + dx x, y + dy y from pt, off where x + dx between 0 and 996 and y + dy between 0 and 990")
def dilate(spark, sf_dir):
    return _morphed(grid(spark, sf_dir), "grp", runs.dilated, runs.square(3), 997, 991)


@query(f"with {GRID}, off as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) a(dx, dy)), v as (select grp, x - dx x, y - dy y, count(*) n from pt, off group by all) select grp, x, y from v where x between 0 and 996 and y between 0 and 990 and n = 5 - cast(x = 0 as int) - cast(x = 996 as int) - cast(y = 0 as int) - cast(y = 990 as int)")
def erode(spark, sf_dir):
    return _morphed(grid(spark, sf_dir), "grp", runs.eroded, runs.ellipse(3), 997, 991)


SHEET_GRID = "pt as (select distinct l_orderkey sheet, cast(l_partkey % 40 as int) x, cast(l_suppkey % 30 as int) y from lineitem)"
SPREAD = "wide as (select distinct sheet, x + dx x, y + dy y from pt, off where x + dx between 0 and 39 and y + dy between 0 and 29)"


def sheet_points(spark, sf_dir):
    """Every line item as a point of its sheet's sparse grid; some repeat, which runs make one."""
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("sheet"), F.expr("cast(l_partkey % 40 as int)").alias("x"), F.expr("cast(l_suppkey % 30 as int)").alias("y"))


@query(f"with {SHEET_GRID}, {OFFSETS}, {SPREAD} select sheet, x, y from wide")
def dilate_sheets(spark, sf_dir):
    return _morphed(sheet_points(spark, sf_dir), "sheet", runs.dilated, runs.square(3), 40, 30)


@query(f"with {SHEET_GRID}, {OFFSETS}, {SPREAD}, plus as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) a(dx, dy)), v as (select sheet, x - dx x, y - dy y, count(*) n from wide, plus group by all) select sheet, x, y from v where x between 0 and 39 and y between 0 and 29 and n = 5 - cast(x = 0 as int) - cast(x = 39 as int) - cast(y = 0 as int) - cast(y = 29 as int)")
def erode_sheets(spark, sf_dir):
    """The dilated grids eroded; single points would leave nothing."""
    own = runs.of_points(sheet_points(spark, sf_dir), ["sheet"])
    closed = runs.worked(own, (40, 30), ["sheet"], lambda s: strips.eroded(strips.dilated(strips.united(s), runs.square(3)), runs.ellipse(3)), reach=2)
    return runs.to_points(closed, ["sheet"])


@query(f"""with recursive {SHEET_GRID}, {OFFSETS}, met as materialized (select a.sheet, a.x, a.y, b.x bx, b.y b_y from pt a, off join pt b on b.sheet = a.sheet and b.x = a.x + dx and b.y = a.y + dy),
  reach as (select sheet, x, y, x tx, y ty from pt union select r.sheet, r.x, r.y, m.bx, m.b_y from reach r join met m on m.sheet = r.sheet and m.x = r.tx and m.y = r.ty),
  label as (select sheet, x, y, min(ty * 40 + tx) label from reach group by all)
  select sheet, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) area from label group by sheet, label having count(*) >= 2""")
def components(spark, sf_dir):
    """Boxes of connected pixels of every sheet's sparse grid."""
    own = runs.of_points(sheet_points(spark, sf_dir), ["sheet"])
    joined = runs.core(runs.united(runs.pieces(own, (40, 30), ["sheet"], ends=False), ["sheet"]))
    return runs.component_boxes(runs.labelled(joined, ["sheet"]), ["sheet"], 2).select("sheet", "x", "y", "w", "h", "area")


@query(f"""with {BOXES}, q as (select sheet, n, p, s, x, y, w + 40 w, h + 40 h from box), m as (select sheet, x px, y py from box),
  t as (select sheet, n, p, s, min(px) tx, min(py) ty, max(px) tx2, max(py) ty2 from q join m using (sheet) where px >= x and px < x + w and py >= y and py < y + h group by all)
  select sheet, n, p, s, coalesce(tx, x) x, coalesce(ty, y) y, coalesce(tx2 - tx + 1, w) w, coalesce(ty2 - ty + 1, h) h from q left join t using (sheet, n, p, s)""")
def tighten(spark, sf_dir):
    """Points are the corners of the sheet's own boxes; tighten_sheets places them elsewhere, so that some boxes stay empty."""
    own = boxes(spark, sf_dir).withColumns({"w": c("w") + 40, "h": c("h") + 40, "id": F.struct("n", "p", "s")})
    points = runs.of_points(boxes(spark, sf_dir), ["sheet"])
    return runs.tightened(own, points, ["sheet"], "id").select("sheet", "n", "p", "s", "x", "y", "w", "h")


@query(f"""with {BOXES}, q as (select sheet, n, p, s, x, y, w + 40 w, h + 40 h from box), m as (select sheet, x + p % 120 px, y + s % 120 py from box),
  t as (select sheet, n, p, s, min(px) tx, min(py) ty, max(px) tx2, max(py) ty2 from q join m using (sheet) where px >= x and px < x + w and py >= y and py < y + h group by all)
  select sheet, n, p, s, coalesce(tx, x) x, coalesce(ty, y) y, coalesce(tx2 - tx + 1, w) w, coalesce(ty2 - ty + 1, h) h from q left join t using (sheet, n, p, s)""")
def tighten_sheets(spark, sf_dir):
    """Points of every sheet, placed so that some miss all boxes and some boxes stay empty."""
    own = boxes(spark, sf_dir).withColumns({"w": c("w") + 40, "h": c("h") + 40, "id": F.struct("n", "p", "s")})
    points = runs.of_points(boxes(spark, sf_dir).select("sheet", (c("x") + c("p") % 120).alias("x"), (c("y") + c("s") % 120).alias("y")), ["sheet"])
    return runs.tightened(own, points, ["sheet"], "id").select("sheet", "n", "p", "s", "x", "y", "w", "h")


@query("select p_partkey, greatest(3, p_size + case when p_size % 2 = 0 then 1 else 0 end) kernel, greatest(1, least(12, case when p_size // 4 = 0 then 1 else p_size // 4 end, case when (p_size + 9) // 4 = 0 then 1 else (p_size + 9) // 4 end)) band from part")
def kernel_sizes(spark, sf_dir):
    band = pixels.border_band(c("p_size") + 9, c("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", pixels.kernel_size(c("p_size")).alias("kernel"), band.cast("int").alias("band"))


# ---- names -------------------------------------------------------------------------------------

SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"select doc_id, {SLUG.format('text')} slug from documents")
def slug_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", naming.slugify(c("text")).alias("slug"))


@query(f"with k as (select p_partkey, coalesce(nullif({SLUG.format('p_name')}, ''), printf('icon-%03d', p_partkey)) k from part) select p_partkey, case when i = 1 then k else printf('%s-%02d', k, i) end stem from (select *, row_number() over (partition by k order by p_partkey) i from k)")
def dedupe_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit(1).alias("run"), "p_partkey", "p_name")
    return naming.name_icons(rows, run=["run"], index="p_partkey", label=c("p_name")).select("p_partkey", "stem")


def _fallback_sql(text: str, source: str) -> str:
    lead = " ".join(f"when starts_with(l, '{x}') then trim(substr(l, {len(x) + 1}), w)" for x in naming.LEAD_INS)
    stop = " ".join(f"when instr(l, '{x}') > 1 then left(l, instr(l, '{x}') - 1)" for x in naming.STOPS)
    return f"""ws as (select chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) w), l0 as (select s.*, w, trim(trim(trim(lower(trim(regexp_split_to_array(trim(coalesce({text}, ''), w), '[\\n\\r\\v\\f]')[1], w)), '"'), ''''), w) l from {source} s, ws),
      l1 as (select * replace (case {lead} else l end as l) from l0), l2 as (select * replace (case {stop} else l end as l) from l1),
      l3 as (select *, trim(left(array_to_string(list_filter(regexp_split_to_array(replace(l, '-', ' '), '\\s+'), lambda x: x <> '')[1:4], '-'), 60), '-') label from l2)"""


SPOKEN = ("This is an image of a red heart, drawn", "the icon shows a magnifier glass that is big", "an image of", "It appears to be a light-bulb; yellow", '"folder"\nsecond line', "a - b", ". . .", "")


@query(f"with src as (select doc_id id, text from documents union all select * from (values {', '.join(f'''({-1 - i}, '{t}')''' for i, t in enumerate(SPOKEN))}) v(id, text)), {_fallback_sql('text', 'src')} select id, label from l3")
def fallback_label(spark, sf_dir):
    spoken = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SPOKEN)], "id long, text string")
    rows = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text").union(spoken)
    return naming.fallback_label(rows, c("text")).select("id", "label")


@query("""select event_id, replace(trim(lower(event_type)), ' ', '-') label, [lower(event_type)] tags, case when event_id % 3 = 0 then null else greatest(0.0, least(1.0, value / 50.0))::double end confidence from events""")
def semantic_parse(spark, sf_dir):
    """Answers made of the events: prose, an object, prose; every third without a confidence."""
    confidence = F.when(c("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(', "confidence": '), (c("value") / 50.0).cast("string")))
    answer = F.concat(F.lit('Sure: {"Label": "'), F.upper("event_type"), F.lit('", "tags": ["'), c("event_type"), F.lit(' ", ""]'), confidence, F.lit("} done"))
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return naming.parse_answer(rows, "answer").select("event_id", "label", "tags", "confidence")


LOCAL = ("http://127.0.0.1:8080", "http://LOCALHOST:11434/x", "http://[::1]:8080", "http://8.8.8.8:8080", "127.0.0.1:8080", "")


@query(f"with u as (select page_id id, url from pages union all select * from (values {', '.join(f'''({-1 - i}, '{u}')''' for i, u in enumerate(LOCAL))}) v(id, url)) select id, lower(regexp_extract(url, '^[a-zA-Z]+://\\[?([^/\\]]*?)\\]?(:[0-9]+)?(/.*)?$', 1)) in ('localhost', '127.0.0.1', '::1') local from u")
def local_url(spark, sf_dir):
    extra = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(LOCAL)], "id long, url string")
    rows = table(spark, sf_dir, "pages").select(c("page_id").alias("id"), "url").union(extra)
    return rows.select("id", naming.is_local_url(c("url")).alias("local"))


ENDINGS = (".PNG", ".jpg", ".jpeg", ".tif", ".webp", ".gif", ".unknown", "")


@query(f"with p as (select p_partkey, 'icons/' || p_name || ([{', '.join(repr(e) for e in ENDINGS)}])[p_partkey % 8 + 1] path from part) select p_partkey, case lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) when '.jpg' then 'image/jpeg' when '.jpeg' then 'image/jpeg' when '.tif' then 'image/tiff' when '.tiff' then 'image/tiff' when '.webp' then 'image/webp' when '.gif' then 'image/gif' else 'image/png' end mime from p")
def mime_by_suffix(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (c("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", naming.mime_by_suffix(F.concat(F.lit("icons/"), c("p_name"), ending)).alias("mime"))


@query(f"select p_partkey, 'out/png/' || {SLUG.format('p_name')} || '.png' path, 'out/png/' || {SLUG.format('p_name')} || '.png' preview from part")
def rename_outputs(spark, sf_dir):
    outputs = F.create_map(F.lit("png"), F.concat(F.lit("out/png/icon_"), c("p_partkey").cast("string"), F.lit(".PNG")))
    renamed = naming.rename_outputs(outputs, naming.slugify(c("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", renamed["png"].alias("path"), naming.preview_of(renamed, F.lit(None)).alias("preview"))


# ---- catalogue and settings --------------------------------------------------------------------

RAW = ("Qwen3-VL-8B-Q4.gguf", "qwen2.5vl:3b", "MiniCPM-V:latest", "moondream2.gguf", "llava-v1.6.gguf", "random-model", "")
NAMED = f"nm as (select p_partkey, ([{', '.join(repr(r) for r in RAW)}])[p_partkey % 7 + 1] || '' nm from part)"
KNOWN = "known as (select * from (values " + ", ".join(f"({o}, '{k}', {p}, '{t}')" for o, k, _, p, t, *_ in catalog.MODELS) + ") v(ord, key, priority, tag)), al as (select distinct ord, key, priority, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') alias from (select ord, key, priority, unnest([key, replace(key, '-', ''), split_part(tag, ':', 1)]) a from known) where a <> '')"


_quoted = lambda t: "'" + t.replace("'", "''") + "'"
SAID = "case {} " + " ".join(f"when '{k}' then {_quoted(t)}" for k, t in catalog.RECOMMENDATIONS.items()) + f" else {_quoted(catalog.UNKNOWN_RECOMMENDATION)} end"


@query(f"with {NAMED}, {KNOWN} select p_partkey, (select min_by(key, ord) from al where contains(regexp_replace(lower(nm), '[^a-z0-9]', '', 'g'), alias)) key, coalesce((select min_by(priority, ord) from al where contains(regexp_replace(lower(nm), '[^a-z0-9]', '', 'g'), alias)), 500) priority, exists (select 1 from al where contains(regexp_replace(lower(nm), '[^a-z0-9]', '', 'g'), alias)) vision, {SAID.format("(select min_by(key, ord) from al where contains(regexp_replace(lower(nm), '[^a-z0-9]', '', 'g'), alias))")} recommendation from nm")
def catalog_match(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, RAW)), (c("p_partkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("name"))
    return catalog.match_catalogue(rows, catalog.aliases(catalog.catalogue(spark)), "name").select("p_partkey", "key", "priority", "vision", "recommendation")


@query("select p_brand, p_name || '#' || p_partkey best from (select *, row_number() over (partition by p_brand order by p_size >= 40, p_size, lower(p_name || '#' || p_partkey)) i from part) where i = 1")
def best_model(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.lit("#"), c("p_partkey").cast("string")).alias("name"), (c("p_size") < 40).alias("vision"), c("p_size").alias("priority"))
    return catalog.best_model(rows, ["p_brand"], "name", "name")


@query("""with down as (select s_nationkey * 10 + s_suppkey % 10 key, s_suppkey id from supplier), held as (select key, id from (select c_nationkey * 10 + c_custkey % 10 key, c_custkey id, row_number() over (partition by c_nationkey * 10 + c_custkey % 10 order by c_custkey) i from customer) where i = 1)
  select key, id, 'downloaded' origin from down union all select key, id, 'cache' from held where key not in (select key from down)""")
def startable_union(spark, sf_dir):
    """Every supplier a downloaded model, every customer a cached one; some keys are on both sides."""
    down = table(spark, sf_dir, "supplier").select((c("s_nationkey") * 10 + c("s_suppkey") % 10).alias("key"), c("s_suppkey").alias("id"))
    cached = table(spark, sf_dir, "customer").select((c("c_nationkey") * 10 + c("c_custkey") % 10).alias("key"), c("c_custkey").alias("id"))
    return catalog.startable(down, catalog.first_of_key(cached, ["key"], ["id"]), "key").select("key", "id", "origin")


@query("select p_partkey from part where p_brand in (select 'Brand#' || (11 + s_suppkey * 3 % 45) from supplier)")
def tag_presence(spark, sf_dir):
    """Tags of all parts, held against the tags of all suppliers."""
    tags = table(spark, sf_dir, "part").withColumn("tag", F.concat("p_brand", F.lit(":"), c("p_size").cast("string")))
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (11 + c("s_suppkey") * 3 % 45).cast("string"), F.lit(":7b")).alias("tag"))
    return catalog.present_tags(tags, have, "tag").select("p_partkey")


CATALOGUE = "m as (select * from (values " + ", ".join(f"('{k}', '{d}', '{t}', {og}::double, {lg}::double, {str(inst).lower()})" for _, k, d, _, t, og, _, _, lg, inst in catalog.MODELS) + ") v(key, display_name, tag, og, lg, inst))"


@query(f"""with {CATALOGUE}, st as (select n_nationkey, n_nationkey % 2 = 0 o, n_nationkey % 3 > 0 l from nation), cd as (select n_nationkey, key, display_name, 'ollama' backend, og gb, inst and o sel from m, st where o and tag <> '' union all select n_nationkey, key, display_name, 'llamacpp', lg, inst and not o from m, st where l)
  select n_nationkey, key, backend, sel default_selected, display_name || ' · ' || case backend when 'ollama' then 'Ollama' else 'llama.cpp' end || ' · ~' || case when gb > 0 then printf('%.1f GB', gb) else 'small' end || ' download' label from cd""")
def candidates(spark, sf_dir):
    states = table(spark, sf_dir, "nation").select("n_nationkey", (c("n_nationkey") % 2 == 0).alias("o"), (c("n_nationkey") % 3 > 0).alias("l"))
    rows = catalog.candidates(states.crossJoin(F.broadcast(catalog.catalogue(spark))), c("o"), c("l"))
    return rows.select("n_nationkey", "key", "backend", "default_selected", catalog.candidate_label(c("display_name"), c("backend"), c("approx_gb"), F.lit(False)).alias("label"))


PRESET = "pr as (select * from (values " + ", ".join(f"('{n}', {a}, {b}, {g})" for n, (a, b, g) in settings.PRESETS.items()) + ") v(preset, p, a, g))"


@query(f"with {PRESET}, r as (select o_orderkey run, case o_orderkey % 5 when 0 then 'Balanced' when 1 then 'Tiny Details' when 2 then 'Loose Sketches' when 3 then 'Bold Shapes' end preset, case when o_custkey % 7 = 0 then 99 end f, case when o_custkey % 2 = 0 then 33 end k from orders) select run, coalesce(f, p, k, 12) padding, coalesce(a, 200) min_area, coalesce(g, k, 13) merge_gap from r left join pr using (preset)")
def settings_overlay(spark, sf_dir):
    k = c("o_orderkey") % 5
    preset = F.when(k == 0, "Balanced").when(k == 1, "Tiny Details").when(k == 2, "Loose Sketches").when(k == 3, "Bold Shapes")
    none = F.lit(None).cast("int")
    runs = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run"), preset.alias("preset"), F.when(c("o_custkey") % 7 == 0, 99).alias("flag_padding"), none.alias("flag_min_area"), none.alias("flag_merge_gap"), F.when(c("o_custkey") % 2 == 0, 33).alias("config_padding"), none.alias("config_min_area"), F.when(c("o_custkey") % 2 == 0, 33).alias("config_merge_gap"))
    return settings.overlay(runs, settings.presets(spark)).select("run", "padding", "min_area", "merge_gap")


@query(f"with {PRESET}, r as (select p_partkey, case when p_size % 2 = 0 then 12 else 8 end p, case when p_size % 3 = 0 then 70 else 200 end a, case when p_size % 2 = 0 then 13 else 9 end g from part) select p_partkey, coalesce(preset, 'Balanced') preset_name from r left join pr using (p, a, g)")
def preset_name(spark, sf_dir):
    even = c("p_size") % 2 == 0
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(even, 12).otherwise(8).alias("padding"), F.when(c("p_size") % 3 == 0, 70).otherwise(200).alias("min_area"), F.when(even, 13).otherwise(9).alias("merge_gap"))
    return settings.preset_name(rows, settings.presets(spark)).select("p_partkey", "preset_name")


@query("select event_id, case when user_id % 10 <= 0 then 0.0 else greatest(0.0, least(1.0, (value / 10.0) / (user_id % 10))) end::double fraction from events")
def progress_fraction(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", settings.progress_fraction(c("value") / 10.0, c("user_id") % 10).alias("fraction"))


#: What servers answer, and what is chosen: every branch of a readiness check.
ANSWERS = (None, "{broken", '{"models":[]}', '{"models":[{"name":"qwen2.5vl:3b"},{"name":"mystery:1b"}]}', '{"models":[{"name":"llava:7b"},7]}', '{"data":[{"id":"z"}]}',
  '{"models":[{"id":"Qwen2.5-VL","capabilities":["completion","multimodal"]}],"data":[{"id":"y"}]}', '{"models":[{"name":"seer","capabilities":["vision"]}]}', '{"models":[{"id":"text","capabilities":["completion"]}]}', '{"models":[5]}', '{"models":[{"id":"","name":"old","capabilities":"vision"}]}')
CHOSEN = ("qwen2.5vl:7b", "llava:7b", "mystery:1b", "", "moondream")
PROVIDERS = ("ollama", "llamacpp", "geometry", "directory")
_pick = lambda values, n: "([" + ", ".join("null" if v is None else f"'{v}'" for v in values) + f"])[{n} % {len(values)} + 1]"


@query(f"""with {KNOWN}, a as (select c_custkey, {_pick(PROVIDERS, "c_nationkey")} provider, c_custkey % 17 > 0 local, {_pick(ANSWERS, "c_custkey")} answer, {_pick(CHOSEN, "c_custkey // 11")} model from customer),
  b as (select *, answer is not null and json_valid(answer) up, exists (select 1 from al where contains(regexp_replace(lower(model), '[^a-z0-9]', '', 'g'), alias)) known, case when answer is not null and json_valid(answer) then answer end j from a),
  d as (select *, json_extract(j, '$.models[*]') m, json_extract(j, '$.data[*]') t from b),
  e as (select *, coalesce(len(list_filter(m, lambda x: split_part(coalesce(json_extract_string(x, '$.name'), ''), ':', 1) = split_part(model, ':', 1))), 0) > 0 pulled, case when len(m) > 0 then m[1] when len(t) > 0 then t[1] end f from d),
  g as (select *, coalesce(nullif(json_extract_string(f, '$.id'), ''), nullif(json_extract_string(f, '$.name'), ''), nullif(model, ''), 'loaded model') named, case when json_type(f, '$.capabilities') = 'ARRAY' then json_extract_string(f, '$.capabilities[*]') end skills from e),
  r as (select c_custkey, model, named, case when provider not in ('ollama', 'llamacpp') then 'no model needed' when not local then 'url not local' when not up then 'not reachable'
    when provider = 'ollama' then case when model = '' then 'no model selected' when not pulled then 'model not pulled' when not known then 'not a known vision model' else 'ready ollama' end
    when f is null then 'no model loaded' when skills is null then 'ready blind' when list_contains(skills, 'multimodal') or list_contains(skills, 'vision') then 'ready llama' else 'not multimodal' end reason from g)
  select c_custkey, reason in ('no model needed', 'not a known vision model') or starts_with(reason, 'ready') ok, case when reason in ('ready ollama', 'ready llama') then true when reason in ('not a known vision model', 'not multimodal') then false end vision_capable,
    case when starts_with(reason, 'ready') then 'ready' else reason end reason, case when reason in ('model not pulled', 'not a known vision model', 'ready ollama') then model when reason in ('ready blind', 'ready llama', 'not multimodal') then named end model from r""")
def preflight(spark, sf_dir):
    """Every customer's provider, answer and choice: all branches of the readiness check."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(PROVIDERS, c("c_nationkey")).alias("provider"), pick(ANSWERS, c("c_custkey")).alias("answer"), pick(CHOSEN, F.floor(c("c_custkey") / 11)).alias("model_name"))
    known = catalog.match_catalogue(rows, catalog.aliases(catalog.catalogue(spark)), "model_name")
    row = catalog.preflight(c("provider"), c("c_custkey") % 17 > 0, c("answer"), c("model_name"), c("vision"))
    return known.select("c_custkey", row.alias("r")).select("c_custkey", "r.*")


@query(f"with {PLACED}, nm as (select *, row_number() over (partition by sheet order by y + h / 2.0, x, n, p, s, e) i from pl) select sheet, cast(i as int) icon_index, printf('icon_%03d', i) label, printf('group-%03d', i) group_id, [x, y, w, h] source_bounds, [512, 512] canvas_size, 'classical_cv' pipeline, map {{'png': 'png/' || printf('icon_%03d', i) || '.png'}}['png'] png from nm")
def metadata_rows(spark, sf_dir):
    from glyphmill.sources import sinks

    icons = icon_manifest(spark, sf_dir).withColumns({"source_bounds": F.array("x", "y", "w", "h"), "source_size": F.array("w", "h"), "canvas_size": F.array(F.lit(CANVAS), F.lit(CANVAS)), "outputs": F.create_map(F.lit("png"), F.concat(F.lit("png/"), c("stem"), F.lit(".png")))})
    rows = sinks.metadata(icons, provider="geometry", naming=False)
    return rows.select("sheet", "icon_index", c("meta.label").alias("label"), c("meta.group_id").alias("group_id"), c("meta.source_bounds").alias("source_bounds"), c("meta.canvas_size").alias("canvas_size"), c("meta.pipeline").alias("pipeline"), c("meta.formats")["png"].alias("png"))


# ---- listings and feeds ------------------------------------------------------------------------


@query(r"with l as (select p_partkey, case p_partkey % 5 when 0 then 'NAME  ID' when 1 then '' when 2 then p_brand || ':cloud  x' else '  ' || p_brand || ':' || p_size || '  abc' end line from part), n as (select p_partkey, split_part(trim(line), ' ', 1) name from l) select * from n where name <> '' and lower(name) <> 'name' and not ends_with(name, ':cloud')")
def model_listing(spark, sf_dir):
    k = c("p_partkey") % 5
    line = F.when(k == 0, "NAME  ID").when(k == 1, "").when(k == 2, F.concat("p_brand", F.lit(":cloud  x"))).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(":"), c("p_size").cast("string"), F.lit("  abc")))
    return catalog.listing_names(table(spark, sf_dir, "part").withColumns({"line": line, "number": k}), "line", "number").select("p_partkey", "name")


@query(r"with l as (select p_partkey, case when p_partkey % 3 = 0 then 'cached models: ' || p_size else '  ' || p_size || '. ' || p_brand || ':Q4 ' end line from part), r as (select p_partkey, regexp_extract(line, '^\s*\d+\.\s+(\S+)\s*$', 1) ref from l) select * from r where ref <> ''")
def cache_listing(spark, sf_dir):
    size = c("p_size").cast("string")
    line = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("cached models: "), size)).otherwise(F.concat(F.lit("  "), size, F.lit(". "), "p_brand", F.lit(":Q4 ")))
    return catalog.cache_refs(table(spark, sf_dir, "part").withColumn("line", line), "line").select("p_partkey", "ref")


@query("""with j as (select c_custkey, '{"models":[{"name":"other"}],"data":[{"id":"' || c_name || '"},{"id":""},3,{"model":"m' || c_nationkey || '"},{"name":"no"}]}' j from customer), e as (select c_custkey, unnest(json_extract(j, '$.data[*]')) e from j) select c_custkey, coalesce(nullif(json_extract_string(e, '$.id'), ''), nullif(json_extract_string(e, '$.model'), '')) name from e where coalesce(nullif(json_extract_string(e, '$.id'), ''), nullif(json_extract_string(e, '$.model'), '')) is not null""")
def served_models(spark, sf_dir):
    """Only what is under data counts, though there are models too."""
    payload = F.concat(F.lit('{"models":[{"name":"other"}],"data":[{"id":"'), "c_name", F.lit('"},{"id":""},3,{"model":"m'), c("c_nationkey").cast("string"), F.lit('"},{"name":"no"}]}'))
    return catalog.served_models(table(spark, sf_dir, "customer").withColumn("j", payload), "j").select("c_custkey", "name")


@query("select c_custkey, case c_custkey % 3 when 0 then '' when 1 then c_name else c_mktsegment || ' ' || c_name end answer from customer")
def chat_text(spark, sf_dir):
    text = F.concat(F.lit('{"choices":[{"message":{"content":"'), "c_name", F.lit('"}}]}'))
    parts = F.concat(F.lit('{"choices":[{"message":{"content":[{"text":"'), "c_mktsegment", F.lit('"},{"type":"image"},{"text":"'), "c_name", F.lit('"}]}}]}'))
    k = c("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", naming.chat_text(F.when(k == 0, '{"choices":[]}').when(k == 1, text).otherwise(parts)).alias("answer"))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model repositories: an order is one, its line items are files."""
    part, k = c("l_partkey").cast("string"), c("l_linenumber") % 4
    named = lambda end: F.concat(F.lit("m-"), part, F.lit(end))
    file = F.when(k == 0, F.concat(F.lit("mmproj-m"), part, F.lit(".gguf"))).when(k == 1, "README.md").when(k == 2, named("-Q4_K_M.gguf")).otherwise(named("-Q8_0.gguf"))
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("repo"), (c("l_partkey") * 10 + c("l_linenumber")).alias("ord"), file.alias("file"))


FILES = """f as (select l_orderkey repo, l_partkey * 10 + l_linenumber ord, case l_linenumber % 4 when 0 then 'mmproj-m' || l_partkey || '.gguf' when 1 then 'README.md' when 2 then 'm-' || l_partkey || '-Q4_K_M.gguf' else 'm-' || l_partkey || '-Q8_0.gguf' end file from lineitem),
  g as (select *, contains(file, 'mmproj') p from f where ends_with(file, '.gguf'))"""


@query(f"with {FILES} select repo, coalesce(min_by(file, ord) filter (not p and contains(lower(file), 'q4_k_m')), min_by(file, printf('%05d', length(file)) || lower(file)) filter (not p)) weights, min_by(file, ord) filter (p) projector from g group by repo")
def repository_files(spark, sf_dir):
    return catalog.weights_and_projector(repo_files(spark, sf_dir), ["repo"], "file", "ord", F.lit("Q4_K_M"))


@query(f"with {FILES} select repo from g group by repo having bool_or(p) and bool_or(not p)")
def model_pairs(spark, sf_dir):
    return catalog.complete_pairs(repo_files(spark, sf_dir), ["repo"], "file")


@query("select event_type status, case when event_id % 4 = 3 then user_id else 0 end completed, case when event_id % 4 = 3 then user_id * 2 else 0 end total from events where event_id % 4 >= 2")
def pull_feed(spark, sf_dir):
    from glyphmill.sources import readers

    k, user = c("event_id") % 4, c("user_id").cast("string")
    head = F.concat(F.lit('{"status":"'), "event_type", F.lit('"'))
    line = F.when(k == 0, " ").when(k == 1, "{broken").when(k == 2, F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(',"completed":'), user, F.lit(',"total":'), (c("user_id") * 2).cast("string"), F.lit("}")))
    return readers.pull_events(table(spark, sf_dir, "events").select(line.alias("line")), "line")


@query("""with recursive e as (select event_type backend, cast(user_id % 10 as varchar) model, ts, epoch_ms(ts) ms, case event_id % 20 when 0 then 'resolve' when 1 then 'done' when 2 then 'error' else 'download' end phase, user_id completed, event_id from events),
  o as (select *, row_number() over (partition by backend, model order by ts, phase, completed, cast(event_id as varchar)) n from e),
  s as (select backend, model, n, event_id, phase, completed, true shows, ms shown, case when phase = 'resolve' then ms end r, case when phase = 'done' then ms end d, case when phase = 'error' then ms end x from o where n = 1
    union all select backend, model, n, event_id, phase, completed, shows, case when shows then ms else shown end, case when phase = 'resolve' then ms else r end, case when phase = 'done' then ms else d end, case when phase = 'error' then ms else x end
    from (select o.*, s.shown, s.r, s.d, s.x, case o.phase when 'resolve' then coalesce(o.ms > s.r, true) when 'done' then coalesce(o.ms > s.d, true) when 'error' then coalesce(o.ms > s.x, true) else o.ms - s.shown > 3600000 end shows
      from s join o on o.backend = s.backend and o.model = s.model and o.n = s.n + 1))
  select backend, model, event_id, phase, greatest(0.0, least(1.0, completed / 50.0))::double fraction from s where shows""")
def progress_lines(spark, sf_dir):
    """Events as feeds, a line an hour at most; the stream's rows are a table in the shared folder."""
    from glyphmill.streaming import progress

    path = f"{sf_dir}/event[s].parquet"  # a stream takes a file by pattern only
    k = c("event_id") % 20
    phase = F.when(k == 0, "resolve").when(k == 1, "done").when(k == 2, "error").otherwise("download")
    feed = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1000).parquet(path)
    rows = feed.select(c("event_type").alias("backend"), (c("user_id") % 10).cast("string").alias("model"), c("ts").cast("timestamp").alias("at"), phase.alias("phase"), c("user_id").alias("completed"), F.lit(50).alias("total"), c("event_id").cast("string").alias("message"))
    lines = progress.shown_lines(rows, every_ms=3_600_000, idle_ms=365 * 86_400_000)
    return streamed(lines, progress.write_lines, "lines").select("backend", "model", c("message").cast("long").alias("event_id"), "phase", "fraction")


@query("select doc_id, md5('data:' || case doc_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'image/webp' end || ';base64,' || base64(encode(coalesce(text, '')))) uri_md5 from documents")
def data_uri(spark, sf_dir):
    k = c("doc_id") % 3
    path = F.when(k == 0, "a/x.unknown").when(k == 1, "a/x.JPG").otherwise("a.b/x.webp")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(naming.data_uri(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), path)).alias("uri_md5"))


@query("select c_nationkey, not bool_or(c_custkey % 40 = 3) and not bool_or(c_custkey % 60 = 7) needed from customer group by c_nationkey")
def first_run(spark, sf_dir):
    """A nation is an installation, its customers are models; some see, and some installations are marked."""
    models = table(spark, sf_dir, "customer").select("c_nationkey", (c("c_custkey") % 40 == 3).alias("vision"), (c("c_custkey") % 60 == 7).alias("marked"))
    return catalog.first_run_needed(models, ["c_nationkey"])


@query(f"""with {CATALOGUE}, cd as (select c_custkey, key, 'ollama' backend, inst and c_custkey % 2 = 0 sel from m, customer where c_custkey % 2 = 0 and tag <> '' union all select c_custkey, key, 'llamacpp', inst and c_custkey % 2 > 0 from m, customer where c_custkey % 3 > 0)
  select c_custkey, key, backend from cd where not (c_custkey + length(key)) % 4 = 0 and (c_custkey % 5 = 0 or sel)""")
def install_selection(spark, sf_dir):
    """What each customer would install: all that isn't there, or the default only."""
    states = table(spark, sf_dir, "customer").select("c_custkey", (c("c_custkey") % 2 == 0).alias("o"), (c("c_custkey") % 3 > 0).alias("l"))
    rows = catalog.candidates(states.crossJoin(F.broadcast(catalog.catalogue(spark))), c("o"), c("l")).withColumn("installed", (c("c_custkey") + F.length("key")) % 4 == 0)
    every = c("c_custkey") % 5 == 0
    return catalog.install_selection(rows.where(every), True).unionByName(catalog.install_selection(rows.where(~every), False)).select("c_custkey", "key", "backend")


# ---- icons, choices and texts ------------------------------------------------------------------


#: A sheet of three by three cells for each customer; an order is a rectangle in its cell, every third a ring; the last order of a cell hides others.
CELL_W, CELL_H, SHEET_W, SHEET_H, RING = 20, 18, 68, 62, 3


def order_sheets(spark, sf_dir) -> DataFrame:
    """Colour runs of all customers' sheets: dark rectangles and rings on a light ground."""
    key = c("o_orderkey")
    last = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("sheet"), (key % 9).cast("int").alias("cell")).agg(F.max("o_orderkey").alias("k"))
    whole = lambda v: v.cast("int")
    left, top = c("cell") % 3 * CELL_W + 4 + whole(c("k") % 3), F.floor(c("cell") / 3).cast("int") * CELL_H + 4 + whole(c("k") % 4)
    ring = last.select("sheet", "k", left.alias("x"), top.alias("top"), whole(9 + c("k") % 5).alias("w"), whole(9 + c("k") % 4).alias("h"))
    lines = ring.select("*", F.posexplode(F.sequence("top", c("top") + c("h") - 1)).alias("i", "y"))
    hollow = (c("k") % 3 == 0) & (c("i") >= RING) & (c("i") < c("h") - RING)
    part = lambda a, z: F.struct(a.alias("x0"), z.alias("x1"))
    parts = F.when(hollow, F.array(part(c("x"), c("x") + RING), part(c("x") + c("w") - RING, c("x") + c("w")))).otherwise(F.array(part(c("x"), c("x") + c("w"))))
    ink = lines.select("sheet", "y", F.inline(parts), whole(c("k") % 200).alias("r"))
    ground = runs.worked(ink.drop("r"), (SHEET_W, SHEET_H), ["sheet"], lambda s: strips.complement(strips.united(s)), empty=True)
    size = [F.lit(SHEET_W).alias("width"), F.lit(SHEET_H).alias("height")]
    light = [F.lit(245).alias(ch) for ch in "rgb"]
    return ink.select("sheet", "y", "x0", "x1", "r", F.lit(40).alias("g"), F.lit(30).alias("b"), *size).unionByName(ground.select("sheet", "y", "x0", "x1", *light, *size))


MIN_AREA, MERGE_GAP, PADDING = 20, 7, 2


def _three(name: str, of: str, how: str, cross: bool) -> str:
    """A mask (v) after a step with a kernel of three by three, or with its cross: the most or the least of the pixels under it."""
    both = "greatest" if how == "max" else "least"
    rows = f"(select *, {how}(v) over (partition by sheet, y order by x rows between 1 preceding and 1 following) a from {of})"
    if cross:
        return f"{name} as materialized (select sheet, y, x, {both}(a, {how}(v) over (partition by sheet, x order by y rows between 1 preceding and 1 following)) v from {rows})"
    return f"{name} as materialized (select sheet, y, x, {how}(a) over (partition by sheet, x order by y rows between 1 preceding and 1 following) v from {rows})"


ELLIPSE = ", ".join(f"({dy}, {dx})" for dy, lo, hi in runs.ellipse(MERGE_GAP) for dx in range(lo, hi + 1))
SHEETS = f"""last as (select o_custkey sheet, cast(o_orderkey % 9 as int) cell, max(o_orderkey) k from orders group by all),
  ring as (select sheet, k, cell % 3 * {CELL_W} + 4 + k % 3 x, cell // 3 * {CELL_H} + 4 + k % 4 y, 9 + k % 5 w, 9 + k % 4 h from last),
  ink as materialized (select sheet, y + i y, x + j x, k % 200 r from (select *, unnest(range(w)) j from (select *, unnest(range(h)) i from ring))
    where k % 3 > 0 or i < {RING} or i >= h - {RING} or j < {RING} or j >= w - {RING}),
  page as (select sheet, y, x from (select distinct sheet from last), range({SHEET_H}) a(y), range({SHEET_W}) b(x)),
  px as materialized (select p.sheet, p.y, p.x, case when i.r is null then 245 else i.r end r, case when i.r is null then 245 else 40 end g, case when i.r is null then 245 else 30 end b from page p left join ink i using (sheet, y, x)),
  lin as (select r, g, b, list_transform([r, g, b], lambda v: case when v / 255.0::double <= 0.04045::double then v / 255.0::double / 12.92::double else pow((v / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end) c from (select distinct r, g, b from px)),
  xyz as (select r, g, b, [(c[1] * 0.412453::double + c[2] * 0.357580::double + c[3] * 0.180423::double) / 0.950456::double, c[1] * 0.212671::double + c[2] * 0.715160::double + c[3] * 0.072169::double, (c[1] * 0.019334::double + c[2] * 0.119193::double + c[3] * 0.950227::double) / 1.088754::double] v from lin),
  f as (select r, g, b, v, list_transform(v, lambda u: case when u > 0.008856::double then cbrt(u) else u * 7.787::double + 16 / 116.0::double end) f from xyz),
  lab as materialized (select r, g, b, (9798 * r + 19235 * g + 3735 * b + 16384) >> 15 gray, list_transform([(case when v[2] > 0.008856::double then cbrt(v[2]) * 116 - 16 else v[2] * 903.3::double end) * 255 / 100, (f[1] - f[2]) * 500 + 128, (f[2] - f[3]) * 200 + 128], lambda u: round_even(greatest(0, least(255, u)), 0)) t from f),
  edge as (select sheet, t, unnest(range((y < 12)::int + (y >= {SHEET_H} - 12)::int + (x < 12)::int + (x >= {SHEET_W} - 12)::int)) from px join lab using (r, g, b)),
  mean as materialized (select sheet, avg(t[1]) l, avg(t[2]) a, avg(t[3]) b from edge group by sheet),
  lim as (select sheet, greatest(12.0::double, quantile_cont(sqrt((t[1] - l) * (t[1] - l) + (t[2] - a) * (t[2] - a) + (t[3] - b) * (t[3] - b)), 0.95::double) * 2.5 + 6) far, greatest(10.0::double, quantile_cont(abs(t[1] - l), 0.95::double) * 2.5 + 4) light from edge join mean using (sheet) group by sheet),
  hist as (select sheet, gray, count(*) n from px join lab using (r, g, b) group by all),
  sums as (select *, sum(n) over u below, sum(n * gray) over u mass, sum(n) over (partition by sheet) al, sum(n * gray) over (partition by sheet) total from hist window u as (partition by sheet order by gray rows unbounded preceding)),
  cuts as (select sheet, coalesce(max_by(gray, (z, -gray)) filter (z is not null), 0) dark from (select *, case when below < al then round(below::double * (al - below) * (mass / below::double - (total - mass) / (al - below)::double) * (mass / below::double - (total - mass) / (al - below)::double), 3) end z from sums) group by sheet),
  told as materialized (select p.sheet, y, x, (sqrt((t[1] - l) * (t[1] - l) + (t[2] - a) * (t[2] - a) + (t[3] - m.b) * (t[3] - m.b)) > far or abs(t[1] - l) > light)::int colour, (gray <= dark)::int v from px p join lab using (r, g, b) join mean m on m.sheet = p.sheet join lim on lim.sheet = p.sheet join cuts on cuts.sheet = p.sheet),
  {_three("d1", "told", "max", False)}, {_three("d2", "d1", "min", False)},
  either as (select sheet, y, x, greatest(colour, d2.v) v from told join d2 using (sheet, y, x)),
  {_three("m1", "either", "min", True)}, {_three("m2", "m1", "max", True)}, {_three("m3", "m2", "max", True)}, {_three("m4", "m3", "max", True)}, {_three("m5", "m4", "min", True)}, {_three("m6", "m5", "min", True)},
  mask as materialized (select sheet, y, x from m6 where v = 1)"""


@query(f"""with recursive {SHEETS},
  wide as (select distinct sheet, y + dy y, x + dx x from mask, (values {ELLIPSE}) e(dy, dx) where y + dy between 0 and {SHEET_H} - 1 and x + dx between 0 and {SHEET_W} - 1),
  isles as (select sheet, y, x, x - row_number() over (partition by sheet, y order by x) i from wide),
  stretch as materialized (select sheet, y, min(x) x0, max(x) + 1 x1, y * 100 + min(x) id from isles group by sheet, y, i),
  met as materialized (select a.sheet, a.id a, b.id b from stretch a join stretch b on a.sheet = b.sheet and abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1),
  reach as (select sheet, id, id seen from stretch union select r.sheet, r.id, m.b from reach r join met m on m.sheet = r.sheet and m.a = r.seen),
  label as (select sheet, id, min(seen) label from reach group by all),
  spread as (select sheet, label, min(x0) x, min(y) y, max(x1) - min(x0) w, max(y) - min(y) + 1 h, sum(x1 - x0) area from stretch join label using (sheet, id) group by all having sum(x1 - x0) >= {MIN_AREA}),
  tight as (select s.sheet, s.label, area, min(m.x) x, min(m.y) y, max(m.x) + 1 x2, max(m.y) + 1 y2 from spread s join mask m on m.sheet = s.sheet and m.x >= s.x and m.x < s.x + s.w and m.y >= s.y and m.y < s.y + s.h group by all),
  box as materialized (select sheet, label, area, greatest(0, x - {PADDING}) x, greatest(0, y - {PADDING}) y, least({SHEET_W}, x2 + {PADDING}) x2, least({SHEET_H}, y2 + {PADDING}) y2 from tight),
  back as materialized (select b.sheet, b.label, m.y, m.x, m.y = b.y or m.x = b.x or m.y = b.y2 - 1 or m.x = b.x2 - 1 frame from box b join m6 m on m.sheet = b.sheet and m.x >= b.x and m.x < b.x2 and m.y >= b.y and m.y < b.y2 where m.v = 0),
  free as (select sheet, label, y, x from back where frame union select b.sheet, b.label, b.y, b.x from free f, (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), back b where b.sheet = f.sheet and b.label = f.label and b.y = f.y + dy and b.x = f.x + dx),
  outs as (select sheet, label, count(*) n from free group by all), grounds as (select sheet, label, count(*) n from back group by all)
  select b.sheet, b.x, b.y, b.x2 - b.x w, b.y2 - b.y h, cast(area as bigint) area, coalesce(o.n, 0) outside, coalesce(g.n, 0) - coalesce(o.n, 0) holes from box b left join outs o using (sheet, label) left join grounds g using (sheet, label)""")
def sheet_icons(spark, sf_dir):
    """Icons of every customer's sheet: box, area, and how much of its crop's background is outside and how much in holes.

    Limits by each sheet's border, the mask, components, tightened boxes and their background, all over runs.
    """
    key = ["sheet"]
    coloured = written(order_sheets(spark, sf_dir), "coloured")
    told = written(detection.limits(coloured, key), "limits")
    mask = written(detection.foreground(coloured, told, key), "mask")
    found = detection.icon_boxes(mask, told, key, min_area=MIN_AREA, merge_gap=MERGE_GAP)
    boxes = written(geometry.pad_clamp(found, PADDING, F.lit(SHEET_W), F.lit(SHEET_H)).select("sheet", c("label").alias("icon"), "x", "y", "w", "h", "area"), "boxes")
    ground = runs.crop_background(mask, boxes.drop("area"), key, "icon").withColumn("n", (c("x1") - c("x0")).cast("long"))
    counted = ground.groupBy("sheet", "icon").agg(F.sum(F.when(c("outside"), c("n")).otherwise(0)).alias("outside"), F.sum(F.when(c("outside"), 0).otherwise(c("n"))).alias("holes"))
    out = boxes.join(counted, ["sheet", "icon"], "left")
    return out.select("sheet", "x", "y", "w", "h", "area", F.coalesce("outside", F.lit(0)).alias("outside"), F.coalesce("holes", F.lit(0)).alias("holes"))


STAR = ((0.5, 0.0), (0.8, 1.0), (0.0, 0.4), (1.0, 0.4), (0.2, 1.0))
_next_point = [*STAR[1:], STAR[0]]


@query(f"""with {BOXES}, sides as (select sheet, n, p, s, e, x + w * v.ax ax, y + h * v.ay ay, x + w * v.bx bx, y + h * v.by_ b_y from box, (values {", ".join(f"({a}::double, {b}::double, {q}::double, {r}::double)" for (a, b), (q, r) in zip(STAR, _next_point, strict=True))}) v(ax, ay, bx, by_)),
  met as (select *, unnest(range(cast(ceil(least(ay, b_y) - 0.5) as bigint), least(900, cast(ceil(greatest(ay, b_y) - 0.5) as bigint)))) l from sides),
  hit as (select sheet, n, p, s, e, l, ax + (l + 0.5::double - ay) * (bx - ax) / (b_y - ay) at_x, case when b_y > ay then 1 else -1 end d from met),
  run as (select *, sum(d) over u turns, lead(at_x) over (partition by sheet, n, p, s, e, l order by at_x, d) next_x from hit window u as (partition by sheet, n, p, s, e, l order by at_x, d rows unbounded preceding)),
  cut as (select *, cast(ceil(least(1000, at_x) - 0.5) as bigint) x0, cast(ceil(least(1000, next_x) - 0.5) as bigint) x1 from run where turns <> 0 and next_x is not null)
  select sheet, n, p, s, e, cast(sum(x1 - x0) as bigint) pixels, count(*) runs, cast(min(x0) as int) x, cast(min(l) as int) y from cut where x0 < x1 group by all""")
def fill_shapes(spark, sf_dir):
    """Every line item as a star, filled: its pixels, runs and corner."""
    key = ["sheet", "n", "p", "s", "e"]
    point = lambda a, b: F.struct((c("x") + c("w") * F.lit(a)).alias("x"), (c("y") + c("h") * F.lit(b)).alias("y"))
    # dealt before they have rings, as a box is less than its outline
    shapes = boxes(spark, sf_dir).repartition(*key[:4]).withColumn("rings", F.array(F.array(*[point(*v) for v in STAR])))
    inner = outlines.filled(shapes, key, F.lit(1000), F.lit(900), deal=False)
    return inner.groupBy(*key).agg(F.sum((c("x1") - c("x0")).cast("long")).alias("pixels"), F.count("*").alias("runs"), F.min("x0").alias("x"), F.min("y").alias("y"))


@query(f"""with recursive {SHEET_GRID}, off as (select * from (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dy)),
  met as materialized (select a.sheet, a.x, a.y, b.x bx, b.y b_y from pt a, off join pt b on b.sheet = a.sheet and b.x = a.x + dx and b.y = a.y + dy),
  reach as (select sheet, x, y, x tx, y ty from pt union select r.sheet, r.x, r.y, m.bx, m.b_y from reach r join met m on m.sheet = r.sheet and m.x = r.tx and m.y = r.ty),
  parts as (select sheet, count(distinct label) n from (select sheet, x, y, min(ty * 40 + tx) label from reach group by all) group by sheet),
  spots as (select sheet, x + q % 2 vx, y + q // 2 vy, 3 - q nook from pt, range(4) r(q)),
  kinds as (select sheet, vx, vy, count(*) n, sum(nook) t from spots group by all),
  sums as (select sheet, count(*) filter (n = 1) q1, count(*) filter (n = 3) q3, count(*) filter (n = 2 and t = 3) qd from kinds group by sheet)
  select sheet, cast(2 * p.n - (q1 - q3 + 2 * qd) // 4 as int) n_rings, q1 + q3 + 2 * qd corners, k.n pixels from sums join parts p using (sheet) join (select sheet, count(*) n from pt group by sheet) k using (sheet)""")
def trace_masks(spark, sf_dir):
    """Every sheet's sparse grid traced to paths, and what filling the paths gives."""
    own = runs.of_points(sheet_points(spark, sf_dir), ["sheet"])
    mask = runs.worked(own, (40, 30), ["sheet"], strips.united)
    corners = written(outlines.rings(mask, ["sheet"]), "corners")
    told = outlines.with_rings(outlines.paths(corners, ["sheet"]))
    back = outlines.filled(told, ["sheet"], F.lit(40), F.lit(30), deal=False).groupBy("sheet").agg(F.sum((c("x1") - c("x0")).cast("long")).alias("pixels"))
    counted = corners.groupBy("sheet").agg(F.count("*").alias("corners"))
    return told.select("sheet", "n_rings").join(counted, "sheet").join(back, "sheet")


ITEM = f"""{BOXES}, item as (select *, cast(row_number() over (partition by sheet order by n, p, s, e) - 1 as int) ord, p % 5 kind from box),
  named as (select *, case when kind = 1 then printf('shape_%04d', row_number() over (partition by sheet, kind order by ord)) else 'e' || ord end elem_id from item where kind < 4),
  drawn as (select *, case kind when 0 then '<rect transform="translate(' when 1 then '<path xmlns="http://www.w3.org/2000/svg" d="M0 0" transform="translate(' when 2 then '<g transform="translate(' else '<text transform="translate(' end opening,
    case when kind = 1 then ') scale(2)" />' else ')" xmlns="http://www.w3.org/2000/svg" id="e' || ord || '"' || case kind when 0 then ' />' when 2 then '><circle r="' || n || '" /></g>' else '>a &amp; b</text>' end end closing from named where s % 7 > 0)"""


def _drawings(spark, sf_dir) -> DataFrame:
    """Every order as a drawing whose elements are its line items, and the items by their place in it."""
    item = boxes(spark, sf_dir).select("sheet", F.struct("n", "p", "s", "e", "x", "y", "w", "h").alias("item"))
    held = item.groupBy("sheet").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def element(i, k):
        name = F.concat(F.lit(' id="e'), k.cast("string"), F.lit('"'))
        kind = i["p"] % 5
        group = F.concat(F.lit("<g"), name, F.lit('><circle r="'), i["n"].cast("string"), F.lit('"/></g> '))
        text = F.concat(F.lit("<text"), name, F.lit(">a &amp; b</text>"))
        return F.when(kind == 0, F.concat(F.lit("<rect"), name, F.lit("/>"))).when(kind == 1, '<path d="M0 0" transform="scale(2)"/>').when(kind == 2, group).when(kind == 3, text).otherwise("<defs><a/></defs>")

    root = '<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000,900">'
    text = F.concat(F.lit(root), F.array_join(F.transform("items", element), ""), F.lit("</svg>"))
    view = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1000.0).alias("w"), F.lit(900.0).alias("h"))
    return held.select(c("sheet").alias("sheet_id"), text.alias("svg"), view.alias("view"), "items")


@query(f"""with {ITEM}, grp as (select sheet, ord group_no, floor(((x - 60) * 2) * (1000 / 2000.0::double)) gx, floor(((y - 60) * 2) * (900 / 1800.0::double)) gy, greatest(1, ceil(400 * (1000 / 2000.0::double))) gw, greatest(1, ceil((h + 150) * 2 * (900 / 1800.0::double))) gh from item where n % 3 = 1),
  hit as (select d.sheet, d.ord, min(group_no) group_no from drawn d join grp g on g.sheet = d.sheet and d.x + d.w / 2.0 between gx - 3 and gx + gw + 3 and d.y + d.h / 2.0 between gy - 3 and gy + gh + 3 group by all),
  put as (select d.*, group_no, coalesce('g' || group_no, 's' || d.ord) key from drawn d left join hit using (sheet, ord)),
  uni as (select sheet, key, any_value(group_no) group_no, min(ord) first_ord, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from put group by sheet, key),
  num as (select *, row_number() over (partition by sheet order by y + h / 2.0, x, group_no is null, group_no, first_ord) icon_index, w + 10 pw, h + 10 ph from uni),
  sca as (select *, least(512.0::double / greatest(1, max(pw) over (partition by sheet)), 512.0::double / greatest(1, max(ph) over (partition by sheet))) scale from num),
  txt as (select p.sheet, p.key, string_agg(opening || (5 - u.x) || ' ' || (5 - u.y) || closing, '' order by ord) body, string_agg(elem_id, ',' order by ord) ids from put p join uni u using (sheet, key) group by p.sheet, p.key)
  select sheet, cast(icon_index as int) icon_index, x - 5 x, y - 5 y, pw w, ph h, ids, md5('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || pw || ' ' || ph || '">' || body || '</svg>') fragment,
    printf('translate(%.4f %.4f) scale(%.6f)', round_even((512 - pw * scale) / 2.0, 4), round_even((512 - ph * scale) / 2.0, 4), round_even(scale, 6)) transform from sca join txt using (sheet, key)""")
def svg_icons(spark, sf_dir):
    """Every order's drawing taken to icons: elements from the text, boxes from lines, groups from boxes of a rendering twice as large."""
    from glyphmill.sources import readers

    drawings = written(vector.parsed(_drawings(spark, sf_dir)), "drawings")
    items = drawings.select("sheet_id", F.posexplode("items").alias("ord", "item")).select("sheet_id", "ord", "item.*")
    told = F.inline(F.transform("children", lambda e: F.struct(e["elem_id"].alias("elem_id"), F.get("items", e["ord"]).alias("item"))))
    boxed = drawings.select("sheet_id", told).where("item.s % 7 > 0")
    lines = boxed.select("sheet_id", F.concat_ws(",", "elem_id", *[c(f"item.{n}").cast("string") for n in "xywh"]).alias("line"))
    own = readers.element_boxes(lines, "line").select("sheet_id", "elem_id", "x", "y", "w", "h")
    groups = items.where("n % 3 = 1").select("sheet_id", c("ord").alias("group_no"), ((c("x") - 60) * 2).alias("x"), ((c("y") - 60) * 2).alias("y"), F.lit(400).alias("w"), ((c("h") + 150) * 2).alias("h"), F.lit(2000).alias("raster_w"), F.lit(1800).alias("raster_h"))
    found = vector.icons(drawings, own, groups, padding=5, canvas=(CANVAS, CANVAS))
    transform = F.regexp_extract("svg", r'<g transform="([^"]*)"', 1)
    return found.select(c("sheet_id").alias("sheet"), "icon_index", "source_bounds.*", F.array_join("elem_ids", ",").alias("ids"), F.md5("fragment").alias("fragment"), transform.alias("transform"))


@query("""with e as (select vec_id, label, list_transform(embedding, lambda v: v::double * 100 * case when label = 0 then 1 else 1 + vec_id % 5 end) v from embeddings),
  m as (select list(a order by i) mean from (select i, avg(x) a from (select unnest(range(1, 65)) i, unnest(v) x from e where label = 0) group by i)),
  d as (select vec_id, label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - mean[i]) * (v[i] - mean[i])))) d, abs(v[1] - mean[1]) dl from e, m),
  t as (select greatest(12.0, quantile_cont(d, 0.95) * 2.5 + 6) lim, greatest(10.0, quantile_cont(dl, 0.95) * 2.5 + 4) light from d where label = 0)
  select vec_id, round(d, 4) d, d > lim or dl > light far, round(lim, 4) lim, round(light, 4) light from d, t""")
def colour_limits(spark, sf_dir):
    """Distances from a border's mean, held against the limits that the border's own distances give."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") * 100 * F.when(c("label") == 0, 1).otherwise(1 + c("vec_id") % 5)).alias("v"))
    limits = pixels.distance_threshold(every.where("label = 0"), "v")
    rows = every.crossJoin(F.broadcast(limits)).withColumns({"d": pixels.distance(c("v"), c("mean")), "dl": F.abs(F.get("v", F.lit(0)) - F.get("mean", F.lit(0)))})
    far = (c("d") > c("limit")) | (c("dl") > c("light_limit"))
    return rows.select("vec_id", F.round("d", 4).alias("d"), far.alias("far"), F.round("limit", 4).alias("lim"), F.round("light_limit", 4).alias("light"))


@query("""select c_custkey, provider, case when provider <> 'geometry' then nullif(m, '') end model, provider <> 'geometry' and m <> '' chosen from (select c_custkey, (['ollama', 'llamacpp', 'directory', 'geometry'])[c_custkey % 4 + 1] provider, case when c_nationkey % 3 = 0 then '' else c_name end m from customer)""")
def provider_summaries(spark, sf_dir):
    provider = F.when(c("c_custkey") % 4 == 0, "ollama").when(c("c_custkey") % 4 == 1, "llamacpp").when(c("c_custkey") % 4 == 2, "directory").otherwise("none")
    model = F.when(c("c_nationkey") % 3 == 0, "").otherwise(c("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", settings.provider_summary(provider, model).alias("s")).select("c_custkey", "s.*")


@query("""with j as (select c_custkey, case c_custkey % 3 when 0 then '{broken' when 1 then '{"models":[{"name":"' || c_name || '"},{"name":""},7]}' else '{"models":[{"name":"n' || c_nationkey || '"},{"name":"n' || c_nationkey || '"}]}' end j from customer),
  e as (select unnest(json_extract(j, '$.models[*]')) e from j where json_valid(j)) select distinct json_extract_string(e, '$.name') tag from e where json_type(e) = 'OBJECT' and json_extract_string(e, '$.name') <> ''""")
def tag_listing(spark, sf_dir):
    named = lambda name: F.concat(F.lit('{"name":"'), name, F.lit('"}'))
    nation = F.concat(F.lit("n"), c("c_nationkey").cast("string"))
    some = F.concat(F.lit('{"models":['), named(c("c_name")), F.lit(',{"name":""},7]}'))
    twice = F.concat(F.lit('{"models":['), named(nation), F.lit(","), named(nation), F.lit("]}"))
    payload = F.when(c("c_custkey") % 3 == 0, "{broken").when(c("c_custkey") % 3 == 1, some).otherwise(twice)
    return catalog.installed_tags(table(spark, sf_dir, "customer").withColumn("j", payload), "j")


KEYS = tuple(catalog.RECOMMENDATIONS) + ("none",)


@query(f"""with k as (select *, case when c_custkey % 3 = 0 then null else {_pick(KEYS, "c_nationkey")} end b, case when c_custkey % 5 = 0 then null else {_pick(KEYS, "c_custkey")} end s from customer)
  select c_custkey, b best, case when b is not null then {SAID.format("b")} end best_note, s selected, case when s is not null then {SAID.format("s")} end selected_note, coalesce(s = b, false) same,
  case when c_custkey % 2 = 0 then 'a|b|' || c_mktsegment else c_mktsegment || '|b|a' end choices from k""")
def model_choices(spark, sf_dir):
    """The best model and the one in use, what is said of either, and the names to choose from."""
    pick = lambda n: F.get(F.array(*map(F.lit, KEYS)), (n % len(KEYS)).cast("int"))
    model = lambda test, key: F.when(test, F.struct(key.alias("name"), key.alias("key")))
    told = catalog.advice(model(c("c_custkey") % 5 != 0, pick(c("c_custkey"))), model(c("c_custkey") % 3 != 0, pick(c("c_nationkey"))))
    running = F.when(c("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array("c_mktsegment"))
    startable = F.when(c("c_custkey") % 2 == 0, F.array(F.lit("b"), c("c_mktsegment"))).otherwise(F.array(F.lit("b"), c("c_mktsegment"), F.lit("a")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", told.alias("t"), F.array_join(catalog.choices(running, startable), "|").alias("choices"))
    note = lambda n: [c(f"t.{n}.name").alias(n), c(f"t.{n}.recommendation").alias(f"{n}_note")]
    return rows.select("c_custkey", *note("best"), *note("selected"), "t.same", "choices")


@query("select p_partkey, p_size || ' x ' || (p_size + 3) source, '512 x 512' canvas, case when p_size % 2 = 0 then 'png, tiff' else 'svg' end formats, cast(greatest(1, round(p_size * 20 * least(1.0, 420.0 / (p_size * 20), 420.0 / (p_size * 10)))) as int) w, cast(greatest(1, round(p_size * 10 * least(1.0, 420.0 / (p_size * 20), 420.0 / (p_size * 10)))) as int) h from part")
def results(spark, sf_dir):
    pair = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    outputs = F.when(c("p_size") % 2 == 0, F.create_map(F.lit("tiff"), F.lit("b"), F.lit("png"), F.lit("a"))).otherwise(F.create_map(F.lit("svg"), F.lit("c")))
    icons = table(spark, sf_dir, "part").select(c("p_partkey").alias("sheet_id"), F.lit(1).alias("icon_index"), F.lit("icon_001").alias("stem"), outputs.alias("outputs"), pair(c("p_size"), c("p_size") + 3).alias("source_size"), pair(F.lit(512), F.lit(512)).alias("canvas_size"))
    sized = table(spark, sf_dir, "part").select(c("p_partkey").alias("sheet_id"), (c("p_size") * 20).alias("w"), (c("p_size") * 10).alias("h"))
    small = sized.withColumns(sheets.thumbnail_size())
    return sheets.results_listing(icons).join(small, "sheet_id").select(c("sheet_id").alias("p_partkey"), "source", "canvas", "formats", "w", "h")
