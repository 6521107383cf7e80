import numpy as np

from quire.operators import layout, raster


def page(h=1000, w=700, head=True, rule=False):
    g = np.full((h, w), 240, np.uint8)
    if head:
        g[30:45, 300:380:2] = 10
    for i in range(16):
        g[100 + 40 * i : 118 + 40 * i, 60:640:2] = 10
    if rule:
        g[760:763, 60:200] = 10
        g[800:815, 60:400:2] = 10
    g[940:955, 320:370:2] = 10
    return g


def test_ink_and_runs():
    g = page()
    assert 10 <= raster.otsu(g) < 240
    bw = raster.ink(g)
    left, right = raster.active_columns(bw)
    assert 50 < left < 75 and 625 < right < 650
    runs = raster.line_runs(bw, left, right)
    assert len(runs) == 18 and runs[0][2] < runs[1][2]
    assert raster.line_runs(np.zeros((50, 50), bool), 0, 49) == []
    assert raster.runs_of(np.array([1, 1, 0, 1], bool)) == [(0, 1), (3, 3)]


def test_rules():
    bw = raster.ink(page(rule=True))
    assert raster.rules(bw, *raster.active_columns(bw)) == [761]
    bw = raster.ink(page())
    assert raster.rules(bw, *raster.active_columns(bw)) == []
    thick = np.full((400, 300), 240, np.uint8)
    thick[100:140, 20:200] = 0
    assert raster.rules(raster.ink(thick), 0, 299) == []


def test_components_against_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.random((14, 17)) < 0.35
        todo, want = {tuple(p) for p in np.argwhere(m)}, []
        while todo:
            stack, comp = [todo.pop()], []
            while stack:
                y, x = stack.pop()
                comp.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
                todo -= near
                stack += near
            ys, xs = [p[0] for p in comp], [p[1] for p in comp]
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(comp)))
        assert sorted(map(tuple, raster.components(m).tolist())) == sorted(want)


def test_photo_and_caption():
    g = np.full((1000, 700), 245, np.uint8)
    g[200:500, 150:500] = 5
    g[530:550, 180:480:2] = 60
    bw = raster.ink(g)
    boxes = [b for b in raster.photo_boxes(raster.dark(g)) if b[4] > 20000]
    assert [b[:4] for b in boxes] == [(150, 200, 350, 300)]
    cap = raster.find_caption(bw, boxes[0][:4], [], [])
    assert cap is not None and 528 <= cap[1] <= 531 and 18 <= cap[3] <= 22
    assert raster.find_caption(bw, boxes[0][:4], [], [cap]) is None
    assert raster.expand_box((160, 210, 330, 280), bw)[0] <= 151
    assert raster.crop(g, (0, 0, 10, 10), 5).shape == (15, 15)


def test_line_art_and_border():
    g = np.full((800, 600), 245, np.uint8)
    g[100:102, 100:500] = g[500:502, 100:500] = 10
    g[100:502, 100:102] = g[100:502, 498:500] = 10
    g[300:302, 110:490] = 10
    bw = raster.ink(g)
    (box,) = [b for b in raster.line_art_boxes(bw) if b[4] > 1000]
    assert box[5] < 0.06
    x, y, w, h = raster.refine_by_border(bw, box[:4])
    assert (x, y) == (100, 100) and abs(x + w - 499) <= 1 and abs(y + h - 501) <= 1


def test_visual_crop_and_normalise():
    top, bottom = raster.visual_crop(page())
    assert 90 <= top <= 101 and 50 <= bottom <= 300
    assert raster.normalised(page()).shape == (1000, 700)


def test_margins_on_images(spark):
    rows = [("b", 1, 1000, 700, page().tobytes()), ("b", 2, 1000, 700, page(rule=True).tobytes()), ("b", 3, 1000, 700, np.full((1000, 700), 240, np.uint8).tobytes())]
    images = spark.createDataFrame(rows, raster.IMAGE)
    out = {r.page_no: r for r in layout.margins(raster.page_runs(images), raster.page_rules(images)).collect()}
    assert set(out) == {1, 2}
    assert out[1].header1 < 60 and out[1].footer0 > 900 and out[1].rule_y is None and out[1].keep_top < 100 < out[1].keep_bottom < 940
    assert out[2].rule_y == 761 and out[2].footer0 is None and out[2].keep_bottom <= 749
    assert raster.page_boxes(images).count() >= 0


def test_spans(spark):
    rows = [(1, 1, 10.0, 200.0, "b"), (1, 2, 12.0, 300.0, "a"), (1, 3, 15.5, 100.0, "c"), (1, 4, 11.0, 250.0, "ً")]
    df = spark.createDataFrame(rows, "page int, span int, y double, x_right double, text string")
    assert [(r.line_no, r.text) for r in layout.visual_lines(df).orderBy("line_no").collect()] == [(1, "a ً b"), (2, "c")]
    chars = spark.createDataFrame([(1, 1, 0, "ق", 10.0), (1, 1, 1, "ل", 5.0), (1, 1, 2, "ً", 6.0)], "page int, span int, i int, c string, ox double")
    assert [(r.c, r.host) for r in layout.host_letters(chars).collect()] == [("ً", "ل")]


def test_drawn_pages_hold_every_line(spark):
    text = "\n".join(["word " * 12] * 40 + ["x" * 400])
    pages = spark.createDataFrame([("b", 1, text), ("b", 2, "a\n" * 25 + "b"), ("b", 3, None)], "book_id string, page_no int, raw_text string")
    images = raster.drawn_pages(pages)
    got = {r.page_no: r for r in images.collect()}
    assert (got[2].height, got[2].width) == (got[3].height, got[3].width) == (480, 320)
    g = np.frombuffer(got[1].pixels, np.uint8).reshape(got[1].height, got[1].width)
    assert ((g < 100).any(1)[16::17][:41]).all() and np.flatnonzero((g[16 + 17 * 40] < 100))[-1] == 30 + 4 * 400 - 2


def test_rules_stand_in_white():
    gaps = [(0, 9), (40, 70), (73, 99)]
    assert raster.in_white(gaps, 71, 100) and raster.in_white(gaps, 72, 100)
    assert not raster.in_white([(0, 9), (60, 99)], 20, 100)  # the white below is too far
    assert not raster.in_white([(0, 8), (12, 20)], 10, 100) and raster.in_white([(0, 8), (12, 29)], 10, 100) and not raster.in_white([], 5, 100)


def test_page_queries(spark):
    from quire.operators import kernels as K

    df = spark.createDataFrame([("b", 1, "head\n\n\n\nbody of the page here\nfoot 1"), ("b", 2, "Title\ngoes on"), ("b", 3, None)], "book_id string, page_no int, raw_text string")
    images = raster.drawn_pages(df)
    assert {r.page_no for r in raster.page_crops(images).collect()} == {1, 2, 3}
    assert raster.page_captions(images).count() >= 0 and raster.page_crops(images.limit(0)).collect() == []
    say = lambda p: {"join": True, "header": "Title", "footer": "foot", "footnote_span": "goes" not in p}
    got = {r.page_no: r.text for r in K.stitch_pages(df, say).collect()}
    assert got == {1: "head\n\n\n\nbody of the page here\n\ngoes on", 2: "", 3: ""}


def test_packed_images_read_as_whole_ones():
    rng = np.random.default_rng(5)
    texts = ["\n".join(("", "____", "x" * int(rng.integers(1, 200)), "ab c")[k] for k in rng.integers(0, 4, rng.integers(1, 60))) for _ in range(40)]
    for t in [*texts, "", None, "a\n\n" * 90]:
        rows, times = raster.drawn(t, 480, 320)
        g = np.repeat(rows, times, axis=0)
        assert raster.packed_levels(rows, times) == raster.otsu(g)
        bw, few = raster.ink(g), rows <= raster.otsu(g)
        at = raster.active_columns(bw)
        assert at == raster.active_columns(few, times=times)
        assert raster.line_runs(bw, *at) == raster.line_runs(few, *at, times) and raster.rules(bw, *at) == raster.rules(few, *at, times)
        assert list(map(tuple, raster.packed_photo_boxes(raster.dark(g), np.ones(len(g), int)).tolist())) == raster.photo_boxes(raster.dark(g))
        assert list(map(tuple, raster.packed_photo_boxes(rows < 0.85 * raster.otsu(g), times).tolist())) == raster.photo_boxes(raster.dark(g))
    for k in (3, 5, 7):
        m = np.repeat(rng.random((9, 30)) < 0.3, rng.integers(1, 30, 9), axis=0)
        c, n = raster.packed_close(*raster.packed(m), k)
        assert (np.repeat(c, n, axis=0) == raster.close(m, k)).all() and (raster.dilate(m, k, 4) == (raster.box_sum(m, k, 4) > 0)).all()


def test_page_margin_is_margins(spark):
    rng = np.random.default_rng(7)
    pages = []
    for no in range(300):
        h, y, runs = int(rng.integers(60, 900)), 0, []
        while (y := y + int(rng.integers(0, 80))) < h - 2 and len(runs) < 12:
            z = min(h - 1, y + int(rng.integers(0, 40)))
            runs.append((y, z, float(rng.choice([0.1, 0.5, 0.9, 1.0]))))
            y = z + 1
        pages.append((no, h, runs, sorted({int(v) for v in rng.integers(0, h, rng.integers(0, 4))})))
    runs = spark.createDataFrame([("b", no, h, *r) for no, h, rs, _ in pages for r in rs], "book_id string, page_no int, height int, y0 int, y1 int, width_frac double")
    lines = spark.createDataFrame([("b", no, y) for no, _, _, ys in pages for y in ys], "book_id string, page_no int, y int")
    want = {tuple(r)[1:] for r in layout.margins(runs, lines).collect()}
    assert want == {(no, *m) for no, h, rs, ys in pages if (m := layout.page_margin(rs, ys, h))} and len(want) > 200


def test_page_images_stay_where_they_are_drawn(spark, tmp_path, monkeypatch):
    from quire.plans import layout_queries as Q

    rows = [("b", 1, "digital", "Head\n\n\n" + "body of the page " * 5 + "\nmore\n___\nfoot"), ("b", 1, "scanned", "one\ntwo"), ("b", 2, None, "x\n" * 9), ("b", 3, None, None), (None, 4, None, "a\nb")]
    rows = [(*r, None) for r in [*rows, rows[0]]]
    spark.createDataFrame(rows, "book_id string, page_no int, pdf_type string, raw_text string, raw_text_pre string").write.parquet(str(tmp_path / "page.parquet"))
    pages = spark.read.parquet(str(tmp_path / "page.parquet")).distinct().where("raw_text IS NOT NULL")
    images = raster.drawn_pages(pages)
    boxes = {(r.book_id, r.page_no): (r.n, r.a) for r in raster.page_boxes(images).groupBy("book_id", "page_no").agg({"area": "sum", "x": "count"}).toDF("book_id", "page_no", "a", "n").collect()}
    margins = {tuple(r) for r in layout.margins(raster.page_runs(images), raster.page_rules(images)).collect()}
    monkeypatch.setattr(raster, "page_boxes", None)
    got = {(r.book_id, r.page_no): (r.n_boxes, r.area) for r in Q.page_boxes(spark, str(tmp_path)).collect()}
    assert (got == boxes or {k: v[::-1] for k, v in got.items()} == boxes) and len(boxes) == 3
    assert {tuple(r) for r in Q.page_margins(spark, str(tmp_path)).collect()} == margins and len(margins) == 2
