"""Small hand-made tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftengine import schema


def rows_of(df, *order):
    """Rows as tuples, in a stable order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def frames(spark, clips, shake=None, frame_numbers=None, fps=30.0):
    """Frame table with metadata from {clip_id: [bar y or None, ...]}; x is 500 where y is."""
    out = []
    for clip, heights in clips.items():
        numbers = (frame_numbers or {}).get(clip) or range(len(heights))
        for i, (frame, y) in enumerate(zip(numbers, heights)):
            dx, dy = (shake or {}).get(clip, [(0.0, 0.0)] * len(heights))[i]
            x = None if y is None else 500.0
            out.append((clip, frame, x, None if y is None else float(y), dx, dy,
                        1920, 1080, fps))
    return spark.createDataFrame(
        out, "clip_id bigint, frame bigint, barbell_x_raw double, barbell_y_raw double, "
             "shake_dx double, shake_dy double, frame_width bigint, frame_height bigint, "
             "fps double")


def analysis(spark, clips, fps=30.0):
    """Analysis table from {clip_id: [dict of columns per frame]}; knees sit at 0.7."""
    out = []
    names = [f.name for f in schema.ANALYSIS.fields]
    for clip, rows in clips.items():
        for i, row in enumerate(rows):
            full = {
                "clip_id": clip, "frame": i, "frame_width": 1920, "frame_height": 1080,
                "left_knee_y": 0.7, "right_knee_y": 0.7, "time_s": i / fps,
                "barbell_x_stable": 500.0, "vel_y_smooth": 50.0, "accel_y_smooth": 1.0,
                "bar_phase": 1, "direction_state": 1.0, "landmarks_str": "{}",
                "barbell_box_str": "",
            } | row
            out.append(tuple(full.get(name) for name in names))
    return spark.createDataFrame(out, schema.ANALYSIS)


def clip_table(spark, clip_ids, lift_type="clean", total_frames=1000, fps=30.0):
    return spark.createDataFrame(
        [(c, 1920, 1080, fps, total_frames, lift_type) for c in clip_ids], schema.CLIPS)


def same(a, b, keys, digits=9):
    """Assert that two tables hold the same rows, doubles to ``digits`` decimals."""
    def rounded(df):
        return df.select(*[
            F.round(c, digits).alias(c) if isinstance(t.dataType, T.DoubleType) else F.col(c)
            for c, t in zip(df.columns, df.schema.fields)])

    left, right = rounded(a).toPandas(), rounded(b.select(*a.columns)).toPandas()
    left = left.sort_values(keys).reset_index(drop=True)
    right = right.sort_values(keys).reset_index(drop=True)
    import pandas.testing as pt

    pt.assert_frame_equal(left, right, check_exact=False, rtol=0, atol=10 ** -digits)
