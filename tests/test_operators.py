"""Operators of the icon pipeline: hand-made cases and brute-force twins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from glyphmill.functions import pictures
from glyphmill.operators import catalog, geometry, labelling, naming, settings, sheets
from glyphmill.plans import registry
from glyphmill.sources import readers, sinks
from glyphmill.streaming import progress


def test_entry_runs(spark):
    assert spark_entry.entry(spark).limit(5).count() == 5
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    cell = lambda v: [cell(x) for x in v] if isinstance(v, (list, tuple)) else (f"{v:.9g}" if isinstance(v, float) else str(v))
    cols = sorted(got.columns)
    mine = sorted(repr([cell(r[c]) for c in cols]) for r in got.collect())
    result = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert mine == sorted(repr([cell(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def order_twin(boxes):
    median = sorted(b[3] for b in boxes)[len(boxes) // 2]
    tolerance, rows = max(20, int(0.75 * median)), []
    for b in sorted(boxes, key=lambda b: (b[1] + b[3] / 2, b[1], b[0], b[4])):
        cy = b[1] + b[3] / 2
        for row in rows:
            if abs(cy - sum(x[1] + x[3] / 2 for x in row) / len(row)) <= tolerance:
                row.append(b)
                break
        else:
            rows.append([b])
    rows.sort(key=lambda r: sum(x[1] + x[3] / 2 for x in r) / len(r))
    return [b[4] for r in rows for b in sorted(r, key=lambda b: b[0])]


def test_reading_order_equals_its_twin(spark):
    rng = random.Random(1)
    rows = [(s, rng.randrange(900) * 2 + 1, rng.randrange(200), rng.randrange(1, 60), rng.randrange(1, 60), i) for s in range(60) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "sheet int, x int, y int, w int, h int, n int")
    got = {}
    for r in geometry.reading_order(df, "sheet", ["n"]).orderBy("sheet", "icon_index").collect():
        got.setdefault(r.sheet, []).append(r.n)
    for s in got:
        assert got[s] == order_twin([(x, y, w, h, n) for k, x, y, w, h, n in rows if k == s])


def test_reading_order_of_a_crowded_sheet(spark):
    """One sheet has nearly all boxes, many at one height; boxes without a sheet are one of their own; no task collects boxes."""
    rng = random.Random(2)
    rows = [(1, rng.randrange(3000), rng.choice((100, rng.randrange(4000))), rng.randrange(1, 60), rng.randrange(1, 60), i) for i in range(3000)]
    rows += [(s, rng.randrange(900), rng.randrange(300), 9, 9, i) for s in (None, 2) for i in range(20)]
    rows += [rows[-1]] * 3
    df = spark.createDataFrame(rows, "sheet int, x int, y int, w int, h int, n int")
    ordered = geometry.reading_order(df, "sheet", ["n"])
    got = ordered.collect()
    assert len(got) == len(rows) and ordered.schema["icon_index"].dataType.simpleString() == "int"
    for s in (1, 2, None):
        mine = sorted((r.icon_index, r.row_no, r.n) for r in got if r.sheet == s)
        assert [n for _, _, n in mine] == order_twin([(x, y, w, h, n) for k, x, y, w, h, n in rows if k == s])
        assert [i for i, _, _ in mine] == list(range(1, len(mine) + 1)) and sorted({r for _, r, _ in mine}) == list(range(1, mine[-1][1] + 1))
    assert geometry.reading_order(df.limit(0), "sheet", ["n"]).count() == 0


def test_reading_order_without_places(spark):
    """Boxes without a height are one row, whatever stretch they are in; boxes and what they are told meet once, the sheets' limits once."""
    rows = [(s, 100 + 300 * i, None if i % 2 else 50, 10, 10, i) for s in (1, None) for i in range(8)] + [(2, None, 5, 9, 9, 0), (2, None, None, 9, 9, 1), (2, 700, None, 9, None, 2)]
    ordered = geometry.reading_order(spark.createDataFrame(rows, "sheet int, x int, y int, w int, h int, n int"), "sheet", ["n"])
    got = sorted((str(r.sheet), r.icon_index, r.row_no, r.n) for r in ordered.collect())
    own = [*[(k + 1, 1, n) for k, n in enumerate((0, 2, 4, 6))], *[(k + 5, 2, n) for k, n in enumerate((1, 3, 5, 7))]]
    assert got == sorted([*[(s, *x) for s in ("1", "None") for x in own], ("2", 1, 1, 0), ("2", 2, 2, 1), ("2", 3, 2, 2)])
    assert ordered._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


ANSWERS = [
    ('prose {"label":"Light Bulb","tags":["Idea"],"confidence":1.7}', "light-bulb", ["idea"], 1.0),
    ("magnifier glass\nextra", "magnifier-glass", [], None),
    ('{"label":"x"}', "x", [], None),
    ('{"label":null}', "none", [], None),
    ("{'label':'x'}", "{'label'", [], None),
    ('{"label":"a","tags":["1","2","3","4","5","6","7"],"confidence":"-3"}', "a", list("123456"), 0.0),
    ('{"label":"a","tags":"no","confidence":"nan"}', "a", [], 1.0),
    (None, "", [], None),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, t string")
    for r in naming.parse_answer(df, "t").collect():
        assert (r.label, r.tags, r.confidence) == ANSWERS[r.i][1:], ANSWERS[r.i]


def test_names(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Heart", "heart", "heart!", "", "?"], 1)], "run int, icon_index int, label string")
    got = [r.stem for r in naming.name_icons(df, run=["run"], index="icon_index", label=F.col("label")).orderBy("icon_index").collect()]
    assert got == ["heart", "heart-02", "heart-03", "icon-004", "icon-005"]


def test_catalogue(spark):
    names = ["Qwen3-VL", "Qwen2.5-VL", "qwen2.5vl:3b", "minicpm-v:latest", "moondream2.gguf", "llava-v1.6.gguf", "random-model.gguf"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.key, r.priority, r.vision) for r in catalog.match_catalogue(df, catalog.aliases(catalog.catalogue(spark)), "name").collect()}
    assert [got[n][0] for n in names] == ["qwen3-vl", "qwen2.5-vl", "qwen2.5-vl", "minicpm-v", "moondream", "llava", None]
    assert got["random-model.gguf"] == (None, 500, False)
    files = spark.createDataFrame([("r", i, f) for i, f in enumerate(["README.md", "m-Q8_0.gguf", "m-Q4_K_M.gguf", "mmproj-m.gguf"])], "repo string, ord int, file string")
    row = catalog.weights_and_projector(files, ["repo"], "file", "ord", F.lit("q4_k_m")).first()
    assert (row.weights, row.projector) == ("m-Q4_K_M.gguf", "mmproj-m.gguf")
    assert catalog.complete_pairs(files, ["repo"], "file").count() == 1
    served = spark.createDataFrame([('{"data":[{"id":"a"},{"id":""},3,{"model":"b"}]}',)], "j string")
    assert [r.name for r in catalog.served_models(served, "j").collect()] == ["a", "b"]
    refs = spark.createDataFrame([("cached models: 2",), ("  1. repo/x:Q4",), ("2. y",)], "l string")
    assert [r.ref for r in catalog.cache_refs(refs, "l").collect()] == ["repo/x:Q4", "y"]


def test_settings():
    assert settings.load(None) == settings.Settings() == settings.load("{broken") and settings.load('{"padding": 3}').padding == 3
    assert settings.load(settings.dump(settings.Settings(padding=5))).padding == 5
    with pytest.raises(TypeError):
        settings.load('{"nope": 1}')
    with pytest.raises(ValueError):
        settings.check_run("a.png", True, ["png"], settings.Settings(provider="ollama", ollama_url="http://8.8.8.8"))
    assert not settings.naming_enabled(settings.Settings(provider="llamacpp", semantic_naming=True))


def test_events(spark, tmp_path):
    lines = spark.createDataFrame([('{"status":"x","completed":50,"total":100}',), ("",), ("broken",), ('{"status":"y"}',)], "value string")
    assert [tuple(r) for r in readers.pull_events(lines, "value").collect()] == [("x", 50, 100), ("y", 0, 0)]
    with pytest.raises(Exception, match="no space"):
        readers.pull_events(spark.createDataFrame([('{"error":"no space"}',)], "value string"), "value").collect()


def test_sheet_end_to_end(spark, tmp_path):
    page = np.full((200, 300, 3), 250, np.uint8)
    page[20:60, 30:80] = (200, 30, 30)
    page[100:160, 150:210] = (20, 20, 120)
    page[115:145, 165:195] = 250
    (tmp_path / "sheet.png").write_bytes(sinks.png_bytes(page))
    found = sheets.icon_boxes(readers.png_sheets(spark, str(tmp_path / "*.png")), min_area=100, merge_gap=5, padding=0).orderBy("icon_index").collect()
    assert [tuple(r.source_bounds) for r in found] == [(30, 20, 50, 40), (150, 100, 60, 60)]


def test_svg_text(spark):
    row = spark.createDataFrame([('<svg a="1"><metadata>old</metadata><g/></svg>', '<path transform="scale(2)" d=""/>', "<rect/>")], "s string, p string, r string")
    got = row.select(sinks.with_metadata(F.col("s"), F.lit('{"a":"<"}')), sinks.shifted(F.col("p"), F.lit(3), F.lit(4)), sinks.shifted(F.col("r"), F.lit(3), F.lit(4)), sinks.svg_of_png(F.lit(bytes(100)).cast("binary"), 5, 6)).first()
    assert got[0] == '<svg a="1"><metadata>{"a":"&lt;"}</metadata><g /></svg>'
    assert sinks.put_metadata("no drawing", "x") == "no drawing"
    deep = sinks.put_metadata('<svg xmlns="http://www.w3.org/2000/svg"><g><metadata>kept</metadata></g><metadata>old</metadata></svg>', "new")
    assert deep == '<svg xmlns="http://www.w3.org/2000/svg"><metadata>new</metadata><g><metadata>kept</metadata></g></svg>'
    canvas = spark.range(1).select(sinks.svg_canvas(F.array(F.lit("<rect/>")), F.array(F.lit("<a/>")), F.lit("scale(2)"), 8, 9)).first()[0]
    assert canvas.endswith('viewBox="0 0 8 9"><defs><a/></defs><g transform="scale(2)"><rect/></g></svg>')
    assert got[1] == '<path transform="translate(3 4) scale(2)" d=""/>' and got[2] == '<rect transform="translate(3 4)"/>'
    assert "\r" not in got[3] and got[3].startswith("<svg")


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for i, text in enumerate(['{"status":"x","completed":50,"total":100}\n\nbroken\n', '{"status":"y"}\n']):
        (tmp_path / "in" / f"{i}.json").write_text(text)
        progress.write_progress(progress.progress(spark, str(tmp_path / "in")), out, marks).awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("status", "completed", "total", "fraction").collect())
    assert got == [("x", 50, 100, 0.5), ("y", 0, 0, 0.0)]


def test_answers_are_asked_again(spark):
    tries = []

    def fails(error, times):
        def ask():
            tries.append(error)
            if len(tries) <= times:
                raise error
            return "ok"

        tries.clear()
        return ask

    assert labelling.asked(fails(ConnectionError(), 2), (0, 0)) == "ok" and len(tries) == 3
    for error, pauses, calls in ((TimeoutError(), (0,), 2), (ValueError(), (0, 0), 1)):
        with pytest.raises(type(error)):
            labelling.asked(fails(error, 9), pauses)
        assert len(tries) == calls

    def client():
        def ask(picture, prompt):
            if picture == b"bad":
                raise ValueError("no picture")
            return f"{prompt} {picture.decode()}"

        return ask

    rows = spark.createDataFrame([(1, b"key", "name"), (2, b"bad", "name"), (3, None, "name")], "i int, png binary, prompt string")
    assert [r.answer for r in labelling.with_answers(rows, client, pauses=()).orderBy("i").collect()] == ["name key", None, None]
    assert labelling.with_answers(rows.limit(0), client).count() == 0


def test_groups_stay_within_their_sheet(spark):
    rng = random.Random(5)
    boxes = [(k, i, rng.randrange(-300, 900), rng.randrange(-300, 900), rng.randrange(1, 700), rng.randrange(1, 700)) for k in (1, 150, 200, 9999, None) for i in range(8)]
    points = [(k, i, rng.randrange(-300, 900), rng.randrange(-300, 900)) for k in (1, 150, 200, 9999, 5, None) for i in range(60)]
    found = geometry.assign_groups(spark.createDataFrame(points, "sheet long, id int, cx int, cy int"), spark.createDataFrame(boxes, "sheet long, g int, x int, y int, w int, h int"), 3, point="id", group="g", keys=("sheet",))
    got = {(r.sheet, r.id): r.g for r in found.collect()}
    want = {(k, i): min((g for s, g, x, y, w, h in boxes if s == k and k is not None and x - 3 <= cx <= x + w + 3 and y - 3 <= cy <= y + h + 3), default=None) for k, i, cx, cy in points}
    assert got == want and len({k for k, g in want.items() if g is not None}) > 50


def test_wide_boxes_are_listed_in_few_cells(spark):
    """Boxes of sheets without points aren't listed at all, and a box of any size is in four cells at most."""
    points = spark.createDataFrame([(1, 1, 90_000, 5), (1, 2, 3, 3), (2, 3, 0, 0)], "sheet long, id int, cx long, cy long")
    boxes = spark.createDataFrame([(1, 7, -100_000, -100_000, 200_000, 200_000), (1, 9, 0, 0, 10, 10), (3, 1, 0, 0, 400, 400)], "sheet long, g int, x int, y int, w int, h int")
    found = geometry.assign_groups(points, boxes, 1, point="id", group="g", keys=("sheet",))
    assert {(r.sheet, r.id): r.g for r in found.collect()} == {(1, 1): 7, (1, 2): 7, (2, 3): None}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and "level" in text


def test_groups_of_all_sheets(spark, sf_dir):
    got = registry.QUERIES["group_assign_sheets"](spark, sf_dir)
    every = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert got.count() == every.count()
    grouped = got.where("group_n is not null").select("sheet").distinct()
    assert grouped.where("sheet >= 200").count() > 0.5 * every.where("l_orderkey >= 200").select("l_orderkey").distinct().count()


def test_components_of_every_sheet(spark, sf_dir):
    cells = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        cells.setdefault(r[0], set()).add((r[1] % 40, r[2] % 30))
    want = []
    for sheet, left in cells.items():
        while left:
            part, todo = [], [left.pop()]
            while todo:
                x, y = todo.pop()
                part.append((x, y))
                near = {(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
                left -= near
                todo += near
            if len(part) > 1:
                xs, ys = zip(*part)
                want.append((sheet, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    assert sorted(tuple(r) for r in registry.QUERIES["components"](spark, sf_dir).collect()) == sorted(want)
    assert len(want) > 20


def test_sheets_are_dilated_eroded_and_tightened_whole(spark, sf_dir):
    sheets = {r[0] for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    for name in ("dilate_sheets", "erode_sheets"):
        assert {r[0] for r in registry.QUERIES[name](spark, sf_dir).select("sheet").distinct().collect()} == sheets
    tight = registry.QUERIES["tighten_sheets"](spark, sf_dir).select("sheet", "n", "p", "s", "x", "y", "w", "h")
    own = registry.boxes(spark, sf_dir).select("sheet", "n", "p", "s", "x", "y", F.col("w") + 40, F.col("h") + 40)
    odd = lambda df: df.where("sheet % 2 = 1")
    changed, same = odd(tight.exceptAll(own)).count(), odd(tight).count() - odd(tight.exceptAll(own)).count()
    assert changed > 500 and same > 100


def test_sheets_become_files_of_icons(spark, tmp_path):
    page = np.full((220, 320, 3), 250, np.uint8)
    page[20:60, 200:250] = (200, 30, 30)
    page[26:66, 30:80] = (30, 200, 30)
    page[130:190, 150:210] = (20, 20, 120)
    page[145:175, 165:195] = 250
    for name in ("a", "b"):
        (tmp_path / f"{name}.png").write_bytes(sinks.png_bytes(page))
    read = readers.png_sheets(spark, str(tmp_path / "*.png"))
    for mode, bitmaps in (("uniform_to_largest", "transparent_preserve_interior"), ("original", "keep_background"), ("individual_fit", "transparent_preserve_interior")):
        rows = sheets.icons(read, min_area=100, merge_gap=5, padding=4, canvas=(48, 48), mode=mode, bitmaps=bitmaps).orderBy("sheet_id", "icon_index").collect()
        assert [(r.stem, tuple(r.source_bounds)) for r in rows] == [("icon_001", (26, 22, 58, 48)), ("icon_002", (196, 16, 58, 48)), ("icon_003", (146, 126, 68, 68))] * 2
        pictures = [sinks.png_pixels(bytes(r.png)) for r in rows]
        assert all(p.shape == (48, 48, 4) for p in pictures)
        if mode == "uniform_to_largest":
            assert rows[0].scale == 48 / 68 and pictures[2][24, 24, 3] == 255 and pictures[2][0, 0, 3] == 0  # the ring's hole is kept, its outside clear
            assert rows[0].dominant_color == "#10c010" and rows[2].palette[0] in ("#101070", "#f0f0f0")
        if mode == "original":
            assert rows[0].scale == 1.0 and tuple(pictures[0][24, 24]) == (30, 200, 30, 255) and tuple(pictures[0][0, 0]) == (250, 250, 250, 255)
    kinds = ["png", "tiff"]
    whole = sheets.with_outputs(sheets.icons(read, min_area=100, merge_gap=5, padding=4, canvas=(48, 48)), str(tmp_path / "out"), kinds)
    files = {r.file for r in sinks.write_pictures(whole, str(tmp_path / "out"), kinds).collect()}
    assert files == {f for r in whole.select("outputs").collect() for f in r.outputs.values()} and len(files) == 12
    back = spark.read.format("image").load(str(tmp_path / "out/*/png/*.png"))
    assert back.count() == 6 and back.where("image.height = 48 and image.nChannels = 4").count() == 6
    meta = sinks.metadata(whole, provider="geometry", naming=False).select("meta.*").orderBy("sheet_index").first()
    assert meta.group_id == "group-001" and meta.formats["png"].endswith("icon_001.png") and meta.dominant_color == "#10c010"


def test_pictures_are_resampled_and_laid_over():
    flat = np.full((10, 20, 4), (100, 150, 200, 255), np.uint8)
    assert (pictures.resample(flat, 7, 5) == flat[0, 0]).all() and pictures.resample(flat, 20, 10) is flat
    clear = np.zeros((4, 4, 4), np.uint8)
    assert (pictures.flattened(clear) == 255).all() and pictures.palette(clear) == []
    assert pictures.compose(flat, 8, 6, 20, 10, -6, -2)[..., 3].all()


def test_requests_and_default_labeller(spark):
    body = labelling.chat_request("", "p", b"x")
    assert "model" not in body and body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,eA=="
    assert labelling.generate_request("m", "p", b"x") == {"model": "m", "prompt": "p", "images": ["eA=="], "stream": False}
    icons = spark.createDataFrame([(b"x", "p"), (None, "p")], "png binary, prompt string")
    assert [r.answer for r in labelling.with_answers(icons).collect()] == ["", None]


def test_listings(spark):
    lines = spark.createDataFrame([(0, "NAME ID"), (1, "name:1 x"), (2, ""), (3, "llava:7b y"), (4, "z:cloud")], "n int, l string")
    names = catalog.listing_names(lines, "l", "n")
    known = catalog.aliases(catalog.catalogue(spark))
    assert [(r.name, r.vision) for r in catalog.listed(names, known).collect()] == [("llava:7b", True), ("name:1", False)]
    served = spark.createDataFrame([('{"models":[{"name":"q"}],"data":[{"id":"z"},{"name":"n"}]}',), ('{"models":[],"data":[{"id":" z "}]}',), ("{broken",), (None,)], "j string")
    assert sorted(r.name for r in catalog.served_models(served, "j").collect()) == ["z", "z"]
    said = catalog.match_catalogue(spark.createDataFrame([("Qwen2.5-VL-3B.gguf",), ("random-model.gguf",)], "name string"), known, "name")
    assert {r.name: (r.priority, r.vision, r.recommendation) for r in said.collect()} == {"Qwen2.5-VL-3B.gguf": (2, True, catalog.RECOMMENDATIONS["qwen2.5-vl"]), "random-model.gguf": (500, False, catalog.UNKNOWN_RECOMMENDATION)}
    paths = spark.createDataFrame([("file:/m/a.b.gguf",), ("file:/m/dir.x/",), ("file:/m/.hidden",)], "p string")
    assert [r.name for r in readers.directory_listing(paths, "p").collect()] == ["a.b", "dir.x"]
    chosen = settings.with_installed(settings.Settings(), "llamacpp", "t", "LLaVA")
    assert chosen.provider == "llamacpp" and settings.naming_enabled(chosen)
    prompts = spark.createDataFrame([("moondream:latest",), ("llava",), ("MiniCPM-V",), (None,)], "m string").select(naming.prompt_for(F.col("m"))).collect()
    assert len({r[0] for r in prompts}) == 4 and all("JSON" in r[0] for r in prompts)


READY = [
    ("ollama", True, None, "qwen2.5vl:3b", (False, None, "not reachable")),
    ("ollama", True, '{"models":[{"name":"llama3:8b"}]}', "qwen2.5vl:3b", (False, None, "model not pulled")),
    ("ollama", True, '{"models":[{"name":"qwen2.5vl:3b"}]}', "qwen2.5vl:latest", (True, True, "ready")),
    ("ollama", True, '{"models":[{"name":"own:1b"}]}', "own:1b", (True, False, "not a known vision model")),
    ("ollama", True, '{"models":[]}', "", (False, None, "no model selected")),
    ("ollama", False, '{"models":[]}', "x", (False, None, "url not local")),
    ("llamacpp", True, '{"models":[{"id":"Qwen2.5-VL","capabilities":["completion","multimodal"]}]}', "", (True, True, "ready")),
    ("llamacpp", True, '{"models":[{"id":"llama-text","capabilities":["completion"]}]}', "", (False, False, "not multimodal")),
    ("llamacpp", True, '{"models":[],"data":[{"id":"old"}]}', "", (True, None, "ready")),
    ("llamacpp", True, "{}", "", (False, None, "no model loaded")),
    ("geometry", False, None, None, (True, None, "no model needed")),
]


def test_readiness(spark):
    rows = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(READY)], "i int, provider string, local boolean, answer string, model string")
    known = catalog.match_catalogue(rows, catalog.aliases(catalog.catalogue(spark)), "model")
    got = known.select("i", catalog.preflight(F.col("provider"), F.col("local"), F.col("answer"), F.col("model"), F.col("vision")).alias("r")).collect()
    assert {r.i: tuple(r.r)[:3] for r in got} == {i: r[4] for i, r in enumerate(READY)}


def test_every_branch_of_the_queries_is_met(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert len({(r.ok, r.vision_capable, r.reason) for r in registry.QUERIES["preflight"](spark, sf_dir).select("ok", "vision_capable", "reason").distinct().collect()}) == 10
    assert {r.needed for r in registry.QUERIES["first_run"](spark, sf_dir).collect()} == {True, False}
    assert {r.origin for r in registry.QUERIES["startable_union"](spark, sf_dir).select("origin").distinct().collect()} == {"downloaded", "cache"}
    some = registry.QUERIES["tag_presence"](spark, sf_dir).count()
    assert 0 < some < spark.read.parquet(f"{sf_dir}/part.parquet").count()
