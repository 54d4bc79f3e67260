"""Text of the scene on a few boxes."""

from fieldglass.operators import scenetext

BOX = "id bigint, camera_id bigint, frame bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, v1 double, w1 double, v2 double, w2 double, picture array<double>"
SIGN, OTHER, FLAT = [1.0, 2.0, 3.0, 9.0], [9.0, 1.0, 4.0, 1.0], [5.0] * 4


def box(i, camera, frame, track, x, vehicle, picture, width=40.0):
    return (i, camera, frame, track, x, 0.0, x + width, 20.0, vehicle, 0.0, vehicle + 100.0, 80.0, picture)


def test_signs_and_what_shows_them(spark):
    rows = [
        box(1, 1, 0, 1, 0.0, 0.0, SIGN), box(2, 1, 40, 2, 1.0, 500.0, [2 * v + 1 for v in SIGN]),  # another vehicle, 40 frames on, brighter
        box(3, 1, 45, 2, 0.0, 500.0, SIGN), box(4, 1, 50, 3, 0.0, 900.0, OTHER),  # the sign again; another picture
        box(5, 1, 10, 4, 300.0, 0.0, SIGN), box(6, 1, 30, 5, 300.0, 500.0, SIGN),  # only 20 frames apart
        box(7, 2, 0, 1, 0.0, 0.0, OTHER), box(8, 2, 90, 1, 0.0, 700.0, OTHER),  # one track
        box(9, 2, 0, 6, 500.0, 0.0, OTHER), box(10, 2, 90, 7, 500.0, 10.0, OTHER),  # one vehicle
        box(11, 3, 0, 1, 0.0, 0.0, FLAT), box(12, 3, 90, 2, 0.0, 500.0, FLAT),  # nothing to see
        box(13, 3, 0, 1, 0.0, 0.0, SIGN, 19.0), box(14, 3, 90, 2, 0.0, 500.0, SIGN, 19.0),  # too small
    ]
    got = scenetext.static_text(spark.createDataFrame(rows, BOX).repartition(3)).collect()
    assert sorted((r.camera_id, r.id) for r in got) == [(1, 1), (1, 2), (1, 3)]
    assert scenetext.static_text(spark.createDataFrame([], BOX)).count() == 0


def test_only_so_many_boxes_before_are_looked_at(spark):
    rows = [box(1, 1, 0, 1, 0.0, 0.0, SIGN), *(box(10 + k, 1, 10 + k, 50 + k, 400.0 + 60 * k, 0.0, OTHER) for k in range(6)), box(30, 1, 99, 2, 0.0, 500.0, SIGN)]
    df = spark.createDataFrame(rows, BOX)
    assert scenetext.static_text(df, 6).count() == 0 and scenetext.static_text(df, 7).count() == 2


def test_a_picture_is_not_sent_for_each_cell(spark, monkeypatch):
    plans = {}

    def noted(df, what, now=scenetext.stored):
        plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return now(df, what)

    monkeypatch.setattr(scenetext, "stored", noted)
    rows = [box(k, 1, 40 * k, k, 0.0, 500.0 * (k % 2), SIGN, 400.0) for k in range(30)]  # wide boxes cover many cells
    assert scenetext.static_text(spark.createDataFrame(rows, BOX), 3).count() == 30
    assert plans["signs"].count("Generate explode(") == 1, plans["signs"]
