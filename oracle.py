"""DuckDB SQL that each registered query must agree with.

Written as named parts over the driver's tables; `sql(name)` puts the parts that a
statement needs in front of it.  The ``fx_`` parts are the views of FIXTURES.md.
"""

from __future__ import annotations

import re
from fractions import Fraction

from liftengine.schema import ANALYSIS_TYPES  # names and types of the contract, no values

# fixed values, written out here so that a wrong one in the engine is noticed
LANDMARKS = (
    "left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee",
    "left_ankle", "right_ankle", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
)
SKELETON_EDGES = (
    ("left_shoulder", "right_shoulder"), ("left_shoulder", "left_hip"),
    ("right_shoulder", "right_hip"), ("left_hip", "right_hip"),
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
)
JOINT_POINTS = {
    "left_knee_angle": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_angle": ("right_hip", "right_knee", "right_ankle"),
    "left_elbow_angle": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_angle": ("right_shoulder", "right_elbow", "right_wrist"),
}
FAULTS = {
    "FP_SLOW": "First Pull: You are slowing down in the first pull",
    "FP_KICK": "First Pull: The bar is being kicked out/pulled back too far",
    "SP_HITCH": "Second Pull: You are hitching in the second pull",
    "SP_JUMP": "Second Pull: You are jumping too soon",
    "SP_ARMS": "Second Pull: You are bending your arms too early",
    "TP_STUCK": "Third Pull: You are getting stuck in the transition",
    "RC_TIRING": "Recovery: Your recovery is too tiring",
}
CHART_TITLES = {
    "vel_y_smooth": "Smoothed Vertical Velocity (px/s)",
    "accel_y_smooth": "Smoothed Vertical Acceleration (px/s^2)",
    "specific_power_y_smooth": "Smoothed Vertical Specific Power",
}
PATH_CHART_TITLE = "Stabilized Bar Path"
WIDTHS = (5, 7, 9, 11, 13, 15)


def cubic_weights(width: int) -> list[list[float]]:
    """Row r: the weights of a window's points in the cubic fitted to them, at place r.

    Least squares by way of polynomials orthogonal on the places, in exact fractions.
    """
    places = [Fraction(i - width // 2) for i in range(width)]
    basis: list[list[Fraction]] = []
    for degree in range(4):
        values = [x ** degree for x in places]
        for b in basis:
            share = sum(v * w for v, w in zip(values, b)) / sum(w * w for w in b)
            values = [v - share * w for v, w in zip(values, b)]
        basis.append(values)
    norms = [sum(w * w for w in b) for b in basis]
    return [[float(sum(b[r] * b[i] / n for b, n in zip(basis, norms))) for i in range(width)]
            for r in range(width)]


PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text.strip()


def sql(statement: str, parts: dict[str, str] = PARTS) -> str:
    """``statement`` with every part it uses, directly or not, as a common table."""
    needed: list[str] = []

    def visit(text):
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in parts and word not in needed and word not in open_parts:
                open_parts.append(word)
                visit(parts[word])
                needed.append(word)

    open_parts: list[str] = []
    visit(statement)
    if not needed:
        return statement
    tables = ",\n".join(f"{name} AS MATERIALIZED (\n{parts[name]}\n)" for name in needed)
    return f"WITH RECURSIVE {tables}\n{statement.strip()}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


# --- inputs ----------------------------------------------------------------------
part("fx_base", """
SELECT clip_id, frame, event_type, v, k,
  (v*31 + k*17 + frame*7) % 1000 AS n, 36 + clip_id % 9 AS f1,
  greatest(frame - 20, 0) AS r
FROM (SELECT user_id AS clip_id,
   CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
   event_type, CAST(round(value*100) AS BIGINT) AS v,
   CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events) e
WHERE NOT (event_type='error' AND k % 4 = 0)
""")
part("fx_clips", """
SELECT clip_id,
 CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(1920 AS BIGINT) END AS frame_width,
 CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(1080 AS BIGINT) END AS frame_height,
 CASE WHEN clip_id % 6 = 5 THEN NULL ELSE CAST(30 AS DOUBLE) END AS fps,
 max(frame) + 13 AS total_frames,
 CASE WHEN clip_id % 10 = 9 THEN 'none' WHEN clip_id % 10 = 8 THEN 'snatch' ELSE 'clean' END AS lift_type
FROM fx_base GROUP BY clip_id
""")
part("fx_frames", """
SELECT clip_id, frame,
 CASE WHEN event_type='signup' AND k % 5 = 0 THEN NULL ELSE CAST(8000 + (CASE WHEN clip_id%2=0 THEN least(r,15)*80 ELSE 0 END) + (n%7)*10 AS DOUBLE)/10e0 END AS barbell_x_raw,
 CASE WHEN event_type='signup' AND k % 5 = 0 THEN NULL ELSE CAST(9180
   - (CASE WHEN clip_id%5=1 THEN 140*least(r,40) - r*r ELSE 60*r + r*r END)
   + (CASE WHEN clip_id%4=0 AND frame BETWEEN f1+12 AND f1+20 THEN (frame-f1-11)*300 ELSE 0 END) + (n%5)*10 AS DOUBLE)/10e0 END AS barbell_y_raw,
 CAST((n % 9) - 4 AS DOUBLE)/4e0 AS shake_dx, CAST((n % 5) - 2 AS DOUBLE)/4e0 AS shake_dy
FROM fx_base
""")
part("fx_landmarks", """
SELECT b.clip_id, b.frame, d.landmark,
 CAST(d.x0 + (b.n + d.j*13) % 4 + (CASE WHEN d.landmark LIKE '%elbow' AND b.clip_id%3=0 AND b.r >= 12 THEN 25 ELSE 0 END) AS DOUBLE)/1000e0 AS x,
 CAST(d.y0 + (b.n + d.j*29) % 4 + (CASE WHEN d.landmark LIKE '%hip' THEN -2*least(b.frame,b.f1)
   + (CASE WHEN b.clip_id%7<4 THEN 30 ELSE 7 END)*least(greatest(b.frame-b.f1,0),10)
   - least(6*greatest(b.frame-b.f1-10,0), (CASE WHEN b.clip_id%7<4 THEN 290 ELSE 60 END)) ELSE 0 END) AS DOUBLE)/1000e0 AS y,
 CAST((b.n + d.j*7) % 200 - 100 AS DOUBLE)/1000e0 AS z,
 CAST((b.n*13 + d.j*31) % 100 AS DOUBLE)/100e0 AS vis
FROM fx_base b CROSS JOIN (SELECT * FROM (VALUES
 (0,'left_shoulder',550,400),(1,'right_shoulder',450,400),(2,'left_hip',540,560),
 (3,'right_hip',460,560),(4,'left_knee',540,740),(5,'right_knee',460,740),
 (6,'left_ankle',540,900),(7,'right_ankle',460,900),(8,'left_elbow',550,500),
 (9,'right_elbow',450,500),(10,'left_wrist',550,600),(11,'right_wrist',450,600)) t(j,landmark,x0,y0)) d
""")
part("fx_detections", """
SELECT clip_id, frame, det_id, class_name, conf,
 cx - 30.25e0 AS x1, cy - 30.25e0 AS y1, cx + 30.75e0 AS x2, cy + 30.75e0 AS y2
FROM (SELECT f.clip_id, f.frame, CAST(c.det_id AS BIGINT) AS det_id,
   CASE WHEN c.det_id = 2 THEN 'plate' ELSE 'endcap' END AS class_name,
   CAST((b.v + c.det_id*37) % 100 AS DOUBLE)/100e0 AS conf,
   f.barbell_x_raw + (CASE WHEN c.det_id = 1 AND b.n % 11 = 0 THEN 1100 ELSE c.dx END) AS cx,
   f.barbell_y_raw + (b.v % c.my) AS cy
 FROM fx_frames f JOIN fx_base b ON f.clip_id = b.clip_id AND f.frame = b.frame
 CROSS JOIN (SELECT * FROM (VALUES (0,0,1),(1,260,40),(2,-40,9)) t(det_id,dx,my)) c
 WHERE f.barbell_y_raw IS NOT NULL) q
""")
part("fx_flow", """
SELECT b.clip_id, b.frame, CAST(f.feat_id AS BIGINT) AS feat_id,
 CAST((b.n + f.feat_id*3) % 9 - 4 AS DOUBLE)/4e0 AS dx,
 CAST((b.n + f.feat_id*5) % 5 - 2 AS DOUBLE)/4e0 AS dy,
 CAST(CASE WHEN (b.n + f.feat_id*f.feat_id) % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS status
FROM fx_base b CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) t(feat_id)) f
WHERE b.frame > 0
""")
part("meta", """
SELECT clip_id, coalesce(frame_width, 1920) AS frame_width,
  coalesce(frame_height, 1080) AS frame_height, coalesce(fps, 30e0) AS fps, total_frames, lift_type
FROM fx_clips
""")

# --- detections --------------------------------------------------------------------
part("wanted", "SELECT * FROM fx_detections WHERE class_name = 'endcap' AND conf >= 0.25e0")
part("clamped", """
SELECT *, CAST(floor((x1 + x2)/2) AS BIGINT) AS cx, CAST(floor((y1 + y2)/2) AS BIGINT) AS cy
FROM (SELECT d.clip_id, d.frame, d.det_id, m.frame_width,
   greatest(0e0, least(d.x1, m.frame_width - 1e0)) AS x1,
   greatest(0e0, least(d.y1, m.frame_height - 1e0)) AS y1,
   greatest(0e0, least(d.x2, m.frame_width - 1e0)) AS x2,
   greatest(0e0, least(d.y2, m.frame_height - 1e0)) AS y2
 FROM wanted d JOIN meta m ON d.clip_id = m.clip_id) q
""")
part("feet", """
SELECT a.clip_id, a.frame,
  avg(CASE WHEN a.vis > 0.3e0 THEN a.x * m.frame_width END) AS feet_x,
  avg(CASE WHEN a.vis > 0.3e0 THEN a.y * m.frame_height END) AS feet_y
FROM fx_landmarks a JOIN meta m ON a.clip_id = m.clip_id
WHERE a.landmark IN ('left_ankle', 'right_ankle') GROUP BY a.clip_id, a.frame
""")
part("cands", """
SELECT c.*, dense_rank() OVER (PARTITION BY c.clip_id ORDER BY c.frame) AS step,
  f.feet_x IS NOT NULL AS by_feet,
  CASE WHEN f.feet_x IS NULL THEN abs(c.cx - c.frame_width/2e0)
   ELSE (c.cx - f.feet_x)*(c.cx - f.feet_x) + (c.cy - f.feet_y)*(c.cy - f.feet_y) END AS first_key
FROM clamped c LEFT JOIN feet f ON c.clip_id = f.clip_id AND c.frame = f.frame
""")
part("first_pick", """
SELECT * FROM (SELECT *, row_number() OVER (
   PARTITION BY clip_id ORDER BY first_key, det_id) AS place FROM cands WHERE step = 1) q
WHERE place = 1
""")
part("walk", """
SELECT clip_id, frame, step, det_id, cx, cy, x1, y1, x2, y2 FROM first_pick
UNION ALL
SELECT clip_id, frame, step, det_id, cx, cy, x1, y1, x2, y2 FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.clip_id ORDER BY
    (c.cx - w.cx)*(c.cx - w.cx) + (c.cy - w.cy)*(c.cy - w.cy), c.det_id) AS place
  FROM walk w JOIN cands c ON c.clip_id = w.clip_id AND c.step = w.step + 1) q
WHERE place = 1
""")
part("shake", """
SELECT f.clip_id, f.frame,
  CASE WHEN f.frame > m.first_frame AND s.n > 5 THEN s.mx ELSE 0e0 END AS shake_dx,
  CASE WHEN f.frame > m.first_frame AND s.n > 5 THEN s.my ELSE 0e0 END AS shake_dy
FROM fx_base f
JOIN (SELECT clip_id, min(frame) AS first_frame FROM fx_base GROUP BY clip_id) m
  ON f.clip_id = m.clip_id
LEFT JOIN (SELECT clip_id, frame, count(*) AS n, median(dx) AS mx, median(dy) AS my
  FROM fx_flow WHERE status = 1 GROUP BY clip_id, frame) s
  ON f.clip_id = s.clip_id AND f.frame = s.frame
""")
part("collected", """
SELECT s.clip_id, s.frame, CAST(w.cx AS DOUBLE) AS barbell_x_raw,
  CAST(w.cy AS DOUBLE) AS barbell_y_raw, s.shake_dx, s.shake_dy, w.x1, w.y1, w.x2, w.y2
FROM shake s LEFT JOIN walk w ON s.clip_id = w.clip_id AND s.frame = w.frame
""")

# --- pose ----------------------------------------------------------------------------
_pose_columns = []
for _name in LANDMARKS:
    for _axis in "xyz":
        _pose_columns.append(
            f"max(CASE WHEN landmark = '{_name}' AND vis > 0.1e0 THEN {_axis} END) AS {_name}_{_axis}")
    _pose_columns.append(f"max(CASE WHEN landmark = '{_name}' THEN vis END) AS {_name}_vis")
for _side in ("left", "right"):
    for _axis in "xz":
        _pose_columns.append(
            f"max(CASE WHEN landmark = '{_side}_shoulder' THEN {_axis} END) AS seen_{_side}_{_axis}")
_point_text = "'''' || landmark || ''': (' || x || ', ' || y || ', ' || z || ', ' || vis || ')'"
_pose_columns.append(
    f"'{{' || string_agg({_point_text}, ', ' ORDER BY landmark) || '}}' AS landmarks_str")
part("pose_wide", "SELECT clip_id, frame,\n " + ",\n ".join(_pose_columns)
     + "\nFROM fx_landmarks GROUP BY clip_id, frame")


def _angle(points):
    a, v, b = points

    def leg(p, axis, size):
        return f"({p}_{axis}*{size} - {v}_{axis}*{size})"

    ax, ay = leg(a, "x", "frame_width"), leg(a, "y", "frame_height")
    bx, by = leg(b, "x", "frame_width"), leg(b, "y", "frame_height")
    norm = f"(sqrt({ax}*{ax} + {ay}*{ay}) * sqrt({bx}*{bx} + {by}*{by}))"
    cosine = f"(({ax}*{bx} + {ay}*{by}) / nullif({norm}, 0))"
    return (f"CASE WHEN {cosine} IS NOT NULL THEN "
            f"degrees(acos(greatest(-1e0, least(1e0, {cosine})))) END")


part("pose", f"""
SELECT p.*, m.frame_width, m.frame_height,
  90e0 - abs(degrees(atan2(seen_left_z - seen_right_z, seen_left_x - seen_right_x)))
    AS lifter_angle_deg,
  {", ".join(f"{_angle(points)} AS {name}" for name, points in JOINT_POINTS.items())},
  (CASE WHEN left_hip_y IS NULL THEN right_hip_y WHEN right_hip_y IS NULL THEN left_hip_y
    ELSE (left_hip_y + right_hip_y)/2 END) * m.frame_height AS hip_y_avg
FROM pose_wide p JOIN meta m ON p.clip_id = m.clip_id
""")

# --- kinematics ------------------------------------------------------------------------
# the steps exist twice: over the frames with their own bar (no prefix) and over the
# frames collected from detections (prefix c_)
_weights = ", ".join(
    f"({width}, {place}, {k}, {float(c)!r}::DOUBLE)"
    for width in WIDTHS for place, row in enumerate(cubic_weights(width))
    for k, c in enumerate(row))
part("weights", f"SELECT * FROM (VALUES {_weights}) t(width, place, k, c)")

_CHAIN = {
    "shaken": """
SELECT f.*, m.fps, m.frame_width, m.frame_height,
  sum(shake_dx) OVER w AS total_shake_x, sum(shake_dy) OVER w AS total_shake_y,
  row_number() OVER w AS rn, lag(frame) OVER w AS prev_frame,
  min(frame) OVER (PARTITION BY f.clip_id) AS first_frame
FROM {source} f JOIN meta m ON f.clip_id = m.clip_id
WINDOW w AS (PARTITION BY f.clip_id ORDER BY f.frame ROWS UNBOUNDED PRECEDING)
""",
    "stable": """
SELECT *, barbell_x_raw - total_shake_x AS barbell_x_stable,
  barbell_y_raw - total_shake_y AS barbell_y_stable FROM {p}shaken
""",
    "peak": """
SELECT s.clip_id, min(s.frame) AS peak_frame FROM {p}stable s
JOIN (SELECT clip_id, min(barbell_y_stable) AS top FROM {p}stable GROUP BY clip_id) t
  ON s.clip_id = t.clip_id AND s.barbell_y_stable = t.top GROUP BY s.clip_id
""",
    "kept": """
SELECT s.* FROM {p}stable s LEFT JOIN {p}peak p ON s.clip_id = p.clip_id
WHERE p.peak_frame IS NULL OR s.frame <= p.peak_frame
""",
    "timed": """
SELECT *, (frame - first_frame)/fps AS time_s,
  coalesce((frame - first_frame)/fps - (prev_frame - first_frame)/fps, 1e0/fps) AS dt
FROM {p}kept
""",
    "moving": """
SELECT *, -((barbell_y_stable - lag(barbell_y_stable) OVER
  (PARTITION BY clip_id ORDER BY frame)) / dt) AS vel_y_px_s FROM {p}timed
""",
    "around": """
SELECT *, count(*) OVER (PARTITION BY clip_id) AS total_rows,
  last_value(CASE WHEN vel_y_px_s IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS left_rn,
  last_value(vel_y_px_s IGNORE NULLS) OVER up AS left_v,
  first_value(CASE WHEN vel_y_px_s IS NOT NULL THEN rn END IGNORE NULLS) OVER dn AS right_rn,
  first_value(vel_y_px_s IGNORE NULLS) OVER dn AS right_v
FROM {p}moving
WINDOW up AS (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING),
  dn AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""",
    "filled": """
SELECT *, CASE WHEN vel_y_px_s IS NOT NULL THEN vel_y_px_s
  WHEN left_v IS NULL THEN 0e0 WHEN right_v IS NULL THEN left_v
  ELSE left_v + (rn - left_rn) * ((right_v - left_v)/(right_rn - left_rn)) END AS vel_filled
FROM {p}around
""",
    "framed": """
SELECT *, CASE WHEN width >= 5 THEN
   greatest(0, least(rn - 1 - width // 2, total_rows - width)) END AS start_at
FROM (SELECT *, least(15, CASE WHEN total_rows % 2 = 0 THEN total_rows - 1 ELSE total_rows END)
   AS width FROM {p}filled) q
""",
    "fitted": """
SELECT a.clip_id, a.frame, sum(b.vel_filled * w.c ORDER BY b.rn) AS fit
FROM {p}framed a
JOIN weights w ON w.width = a.width AND w.place = a.rn - 1 - a.start_at
JOIN {p}filled b ON b.clip_id = a.clip_id AND b.rn - 1 = a.start_at + w.k
GROUP BY a.clip_id, a.frame
""",
    "smoothed": """
SELECT a.*, CASE WHEN a.width >= 5 THEN f.fit ELSE a.vel_filled END AS vel_y_smooth
FROM {p}framed a LEFT JOIN {p}fitted f ON a.clip_id = f.clip_id AND a.frame = f.frame
""",
    "accelerated": """
SELECT *, greatest(10e0, max(abs(vel_y_smooth)) OVER (PARTITION BY clip_id) * 0.05e0)
   AS vel_threshold,
  (vel_y_smooth - lag(vel_y_smooth) OVER (PARTITION BY clip_id ORDER BY frame)) / dt
   AS accel_y_smooth
FROM {p}smoothed
""",
    "directed": """
SELECT *, coalesce(last_value(CASE WHEN vel_y_smooth > vel_threshold THEN 1e0
    WHEN vel_y_smooth < -vel_threshold THEN -1e0 END IGNORE NULLS) OVER
   (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 1e0) AS direction_state,
  accel_y_smooth * vel_y_smooth AS specific_power_y_smooth
FROM {p}accelerated
""",
    "changed": """
SELECT *, direction_state IS DISTINCT FROM lag(direction_state) OVER
  (PARTITION BY clip_id ORDER BY frame) AS phase_change FROM {p}directed
""",
    "phased": """
SELECT *, CAST(sum(CASE WHEN phase_change THEN 1 ELSE 0 END) OVER
  (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bar_phase
FROM {p}changed
""",
    # the analysis table, unrounded
    "analysed": """
SELECT k.*, {pose_columns}, {box} AS barbell_box_str,
  coalesce(p.landmarks_str, '{{}}') AS landmarks_str
FROM {p}phased k LEFT JOIN pose p ON k.clip_id = p.clip_id AND k.frame = p.frame
""",
    # --- critique
    "based": """
SELECT clip_id, avg(barbell_y_stable) AS baseline_y FROM {p}analysed WHERE rn <= 30 GROUP BY clip_id
""",
    "begun": """
SELECT a.clip_id, min(a.frame) AS t0 FROM {p}analysed a JOIN {p}based b ON a.clip_id = b.clip_id
WHERE a.barbell_y_stable < b.baseline_y - a.frame_height * 0.02e0 GROUP BY a.clip_id
""",
    "at_knees": """
SELECT a.clip_id, min(a.frame) AS t1 FROM {p}analysed a JOIN {p}begun b ON a.clip_id = b.clip_id
WHERE a.frame >= b.t0
  AND a.barbell_y_stable <= (a.left_knee_y + a.right_knee_y)/2 * a.frame_height
GROUP BY a.clip_id
""",
    "turned": """
SELECT clip_id, frame AS t2 FROM (SELECT a.clip_id, a.frame, row_number() OVER (
   PARTITION BY a.clip_id ORDER BY a.hip_y_avg, a.frame) AS place
  FROM {p}analysed a JOIN {p}at_knees k ON a.clip_id = k.clip_id
  WHERE a.frame >= k.t1 AND a.hip_y_avg IS NOT NULL) q WHERE place = 1
""",
    "caught": """
SELECT clip_id, frame AS t3 FROM (SELECT a.clip_id, a.frame, row_number() OVER (
   PARTITION BY a.clip_id ORDER BY a.hip_y_avg DESC, a.frame) AS place
  FROM {p}analysed a JOIN {p}turned k ON a.clip_id = k.clip_id
  WHERE a.frame >= k.t2 AND a.hip_y_avg IS NOT NULL) q WHERE place = 1
""",
    "topped": """
SELECT clip_id, frame AS t4 FROM (SELECT clip_id, frame, row_number() OVER (
   PARTITION BY clip_id ORDER BY barbell_y_stable, frame) AS place
  FROM {p}analysed WHERE barbell_y_stable IS NOT NULL) q WHERE place = 1
""",
    "bordered": """
SELECT m.clip_id, m.lift_type, CASE WHEN c.t3 IS NULL THEN NULL ELSE b.t0 END AS t0,
  CASE WHEN c.t3 IS NULL THEN NULL ELSE k.t1 END AS t1,
  CASE WHEN c.t3 IS NULL THEN NULL ELSE h.t2 END AS t2, c.t3,
  CASE WHEN c.t3 IS NULL THEN NULL ELSE e.t4 END AS t4
FROM meta m LEFT JOIN {p}begun b ON m.clip_id = b.clip_id
LEFT JOIN {p}at_knees k ON m.clip_id = k.clip_id LEFT JOIN {p}turned h ON m.clip_id = h.clip_id
LEFT JOIN {p}caught c ON m.clip_id = c.clip_id LEFT JOIN {p}topped e ON m.clip_id = e.clip_id
""",
    "sliced": """
SELECT b.clip_id, s.phase, a.frame, a.rn, a.time_s, a.accel_y_smooth, a.barbell_x_stable,
  a.vel_y_smooth, a.hip_y_avg, a.frame_height, a.left_elbow_angle, a.right_elbow_angle,
  CASE WHEN a.left_ankle_y IS NULL THEN a.right_ankle_y
    WHEN a.right_ankle_y IS NULL THEN a.left_ankle_y
    ELSE (a.left_ankle_y + a.right_ankle_y)/2 END AS ankle_y,
  row_number() OVER (PARTITION BY b.clip_id, s.phase ORDER BY a.frame) - 1 AS place,
  count(*) OVER (PARTITION BY b.clip_id, s.phase) AS n_rows
FROM {p}bordered b
JOIN (VALUES ('first_pull'), ('second_pull'), ('third_pull'), ('recovery')) s(phase) ON TRUE
JOIN {p}analysed a ON a.clip_id = b.clip_id AND a.frame BETWEEN
  (CASE s.phase WHEN 'first_pull' THEN b.t0 WHEN 'second_pull' THEN b.t1
    WHEN 'third_pull' THEN b.t2 ELSE b.t3 END)
  AND (CASE s.phase WHEN 'first_pull' THEN b.t1 WHEN 'second_pull' THEN b.t2
    WHEN 'third_pull' THEN b.t3 ELSE b.t4 END)
""",
    "edges_of_slices": """
SELECT clip_id, phase, max(CASE WHEN place = 0 THEN barbell_x_stable END) AS x_start,
  max(CASE WHEN place = 0 THEN ankle_y END) AS ankle_start,
  max(CASE WHEN place = n_rows - 1 THEN ankle_y END) AS ankle_end,
  max(CASE WHEN place = 0 THEN hip_y_avg END) AS hip_start,
  max(CASE WHEN place = 0 THEN time_s END) AS time_start,
  max(CASE WHEN place = n_rows - 1 THEN time_s END) AS time_end
FROM {p}sliced GROUP BY clip_id, phase
""",
    "found_faults": """
SELECT s.clip_id,
  coalesce(avg(CASE WHEN s.phase = 'first_pull' THEN accel_y_smooth END) <= 0, FALSE) AS fp_slow,
  coalesce(max(CASE WHEN s.phase = 'first_pull' THEN abs(barbell_x_stable - x_start) END)
    > max(frame_height) * 0.05e0, FALSE) AS fp_kick,
  coalesce(avg(CASE WHEN s.phase = 'second_pull' AND n_rows >= 2 AND place >= n_rows // 2
      THEN accel_y_smooth END)
    < avg(CASE WHEN s.phase = 'second_pull' AND n_rows >= 2 AND place < n_rows // 2
      THEN accel_y_smooth END), FALSE)
   OR coalesce(avg(CASE WHEN s.phase = 'second_pull' AND n_rows >= 2 THEN accel_y_smooth END) <= 0,
    FALSE) AS sp_hitch,
  coalesce(max(CASE WHEN s.phase = 'second_pull' THEN ankle_start - ankle_end END)
    > max(frame_height) * 0.02e0, FALSE) AS sp_jump,
  coalesce(max(CASE WHEN s.phase = 'second_pull' THEN (ankle_start - ankle_end) * frame_height END)
    > max(frame_height) * 0.02e0, FALSE) AS sp_jump_px,
  coalesce(min(CASE WHEN s.phase = 'second_pull' THEN
    least(left_elbow_angle, right_elbow_angle) END) < 160e0, FALSE) AS sp_arms,
  CASE WHEN min(CASE WHEN s.phase = 'third_pull' AND hip_y_avg > hip_start + frame_height*0.05e0
      THEN time_s END) IS NOT NULL
    THEN min(CASE WHEN s.phase = 'third_pull' AND hip_y_avg > hip_start + frame_height*0.05e0
      THEN time_s END) - max(CASE WHEN s.phase = 'third_pull' THEN time_start END) > 0.1e0
    ELSE coalesce(max(CASE WHEN s.phase = 'third_pull' THEN time_end - time_start END) > 0.2e0,
      FALSE) END AS tp_stuck,
  coalesce(bool_or(s.phase = 'recovery' AND vel_y_smooth < -10e0), FALSE) AS rc_tiring
FROM {p}sliced s JOIN {p}edges_of_slices e ON s.clip_id = e.clip_id AND s.phase = e.phase
GROUP BY s.clip_id
""",
    "border_times": """
SELECT b.*, a0.time_s AS s0, a1.time_s AS s1, a2.time_s AS s2, a3.time_s AS s3, a4.time_s AS s4
FROM {p}bordered b
LEFT JOIN {p}analysed a0 ON a0.clip_id = b.clip_id AND a0.frame = b.t0
LEFT JOIN {p}analysed a1 ON a1.clip_id = b.clip_id AND a1.frame = b.t1
LEFT JOIN {p}analysed a2 ON a2.clip_id = b.clip_id AND a2.frame = b.t2
LEFT JOIN {p}analysed a3 ON a3.clip_id = b.clip_id AND a3.frame = b.t3
LEFT JOIN {p}analysed a4 ON a4.clip_id = b.clip_id AND a4.frame = b.t4
""",
    "fault_rows": "\nUNION ALL\n".join(
        f"SELECT f.clip_id, CAST({i} AS BIGINT) AS ord, '{code}' AS code, '{message}' AS message "
        f"FROM {{p}}found_faults f JOIN meta m ON f.clip_id = m.clip_id "
        f"WHERE m.lift_type = 'clean' AND f.{code.lower()}"
        for i, (code, message) in enumerate(FAULTS.items(), 1)),
    "statuses": """
SELECT b.clip_id, b.lift_type, CASE WHEN b.t0 IS NULL THEN 'unidentified' ELSE 'identified' END
   AS status, coalesce(n.n, 0) AS n_faults,
  CASE WHEN b.t0 IS NULL THEN 'Could not identify lift phases.'
    WHEN coalesce(n.n, 0) = 0 THEN 'No faults detected.' ELSE 'Faults detected.' END AS message
FROM {p}bordered b
LEFT JOIN (SELECT clip_id, count(*) AS n FROM {p}fault_rows GROUP BY clip_id) n
  ON b.clip_id = n.clip_id WHERE b.lift_type <> 'none'
""",
    "gaps": """
SELECT clip_id, count(CASE WHEN frame - prev_frame > 1 THEN 1 END) AS frame_gaps
FROM {p}shaken GROUP BY clip_id
""",
    "rates": """
SELECT clip_id, count(barbell_y_stable) AS tracked_frames, count(*) AS total_frames,
  100e0 * count(barbell_y_stable) / count(*) AS detection_rate FROM {p}kept GROUP BY clip_id
""",
    "summed": """
SELECT m.clip_id, m.lift_type, g.frame_gaps, r.total_frames AS kept_frames, r.tracked_frames,
  round(r.detection_rate, 6) + 0e0 AS detection_rate,
  CAST((a.v >= 2)::INT + (a.a >= 2)::INT + (a.p >= 2)::INT + (a.xy > 2)::INT AS BIGINT) AS charts,
  'done' AS analysis_part, 'done' AS overlay_part, coalesce(s.status, 'skipped') AS critique_part,
  coalesce(s.n_faults, 0) AS n_faults
FROM meta m JOIN {p}gaps g ON m.clip_id = g.clip_id JOIN {p}rates r ON m.clip_id = r.clip_id
JOIN (SELECT clip_id, count(vel_y_smooth) AS v, count(accel_y_smooth) AS a,
   count(specific_power_y_smooth) AS p, count(barbell_y_stable) AS xy
  FROM {p}phased GROUP BY clip_id) a ON m.clip_id = a.clip_id
LEFT JOIN {p}statuses s ON m.clip_id = s.clip_id
""",
}
_POSE_ONLY = [c for c in ANALYSIS_TYPES if c.endswith(("_x", "_y", "_z", "_vis"))
              and c.startswith(("left", "right"))]
_POSE_ONLY += ["lifter_angle_deg", *JOINT_POINTS, "hip_y_avg"]
for _prefix, _source, _box in (
    ("", "fx_frames", "''"),
    ("c_", "collected", "CASE WHEN k.x1 IS NULL THEN '' ELSE "
     "printf('%.2f,%.2f,%.2f,%.2f', k.x1, k.y1, k.x2, k.y2) END"),
):
    for _name, _text in _CHAIN.items():
        part(_prefix + _name, _text.format(
            p=_prefix, source=_source, box=_box,
            pose_columns=", ".join(f"p.{c}" for c in _POSE_ONLY)))

# --- charts and overlay, over the collected frames ------------------------------------
part("series", "\nUNION ALL\n".join(
    f"SELECT clip_id, '{m}' AS metric, frame, time_s, {m} AS value FROM phased "
    f"WHERE {m} IS NOT NULL AND clip_id IN "
    f"(SELECT clip_id FROM phased GROUP BY clip_id HAVING count({m}) >= 2)"
    for m in CHART_TITLES))
part("charted", f"""
SELECT m.clip_id, c.chart, c.points, CASE WHEN c.points >= c.needed THEN 'produced'
  WHEN c.points = 0 THEN 'missing' ELSE 'insufficient' END AS status
FROM meta m JOIN (
 {" UNION ALL ".join(
    f"SELECT clip_id, '{t}' AS chart, count({m}) AS points, 2 AS needed FROM phased GROUP BY clip_id"
    for m, t in CHART_TITLES.items())}
 UNION ALL SELECT clip_id, '{PATH_CHART_TITLE}', count(barbell_y_stable), 3 FROM phased
   GROUP BY clip_id) c ON m.clip_id = c.clip_id
""")
part("c_points", """
SELECT clip_id, frame, barbell_x_stable AS x, barbell_y_stable AS y, bar_phase, direction_state,
  row_number() OVER w AS pt, lag(bar_phase) OVER w AS prev_phase, lag(frame) OVER w AS prev_frame,
  lead(bar_phase) OVER w AS next_phase, lead(frame) OVER w AS next_frame,
  count(*) OVER (PARTITION BY clip_id) AS n_points
FROM c_phased WHERE barbell_x_stable IS NOT NULL AND barbell_y_stable IS NOT NULL
WINDOW w AS (PARTITION BY clip_id ORDER BY frame)
""")
part("c_runs", """
SELECT clip_id, bar_phase, min(pt) AS a, max(pt) AS b, max(n_points) AS n_points,
  max(direction_state) AS direction_state,
  CAST(row_number() OVER (PARTITION BY clip_id ORDER BY min(pt)) AS BIGINT) AS segment
FROM c_points WHERE n_points > 2 GROUP BY clip_id, bar_phase
""")
part("c_plan", """
SELECT q.clip_id, q.fps, q.all_points, CAST(f.frame AS BIGINT) AS frame FROM (
  SELECT m.clip_id, m.fps, l.all_points,
    least(l.last_frame + CAST(floor(m.fps) AS BIGINT), m.total_frames) AS n_frames
  FROM meta m JOIN (SELECT clip_id, max(frame) AS last_frame,
     count(CASE WHEN barbell_x_stable IS NOT NULL AND barbell_y_stable IS NOT NULL THEN 1 END)
       AS all_points FROM c_phased GROUP BY clip_id) l ON m.clip_id = l.clip_id) q,
  LATERAL (SELECT unnest(range(q.n_frames)) AS frame) f
""")
part("c_states", """
SELECT p.clip_id, p.frame, a.frame IS NOT NULL AS analysed,
  coalesce(last_value(a.total_shake_x IGNORE NULLS) OVER w, 0e0) AS shake_x,
  coalesce(last_value(a.total_shake_y IGNORE NULLS) OVER w, 0e0) AS shake_y,
  CASE WHEN a.frame IS NOT NULL THEN a.lifter_angle_deg
    ELSE last_value(a.lifter_angle_deg IGNORE NULLS) OVER w END AS lifter_angle_deg,
  CASE WHEN a.frame IS NOT NULL THEN a.time_s ELSE p.frame/p.fps END AS time_s,
  CASE WHEN a.frame IS NOT NULL THEN count(a.barbell_y_stable) OVER w ELSE p.all_points END
    AS path_points
FROM c_plan p LEFT JOIN c_analysed a ON p.clip_id = a.clip_id AND p.frame = a.frame
WINDOW w AS (PARTITION BY p.clip_id ORDER BY p.frame ROWS UNBOUNDED PRECEDING)
""")
_color_of = "CASE {0} % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'orange' ELSE 'green' END"
part("c_trail", f"""
SELECT a.clip_id, CAST(a.pt AS BIGINT) AS segment, b.frame, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
  {_color_of.format("a.bar_phase")} AS color
FROM c_points a JOIN c_points b ON a.clip_id = b.clip_id AND b.pt = a.pt + 1
""")
part("c_boxes", """
SELECT clip_id, frame, CAST(trunc(round(x1, 2)) AS BIGINT) AS x1, CAST(trunc(round(y1, 2)) AS BIGINT) AS y1,
  CAST(trunc(round(x2, 2)) AS BIGINT) AS x2, CAST(trunc(round(y2, 2)) AS BIGINT) AS y2
FROM c_kept WHERE x1 IS NOT NULL
""")


def _edge_color(a, b):
    if all(n.split("_")[1] in ("shoulder", "hip") for n in (a, b)):
        return "Torso"
    side = a.split("_")[0].capitalize()
    return f"{side} " + ("Leg" if "knee" in a + b else "Arm")


part("edges", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}', '{b}', '{_edge_color(a, b)}')" for i, (a, b) in enumerate(SKELETON_EDGES))
    + ") t(edge, a, b, color)")
part("c_joints", """
SELECT l.clip_id, l.frame, l.landmark, CAST(trunc(l.x * m.frame_width) AS BIGINT) AS x1,
  CAST(trunc(l.y * m.frame_height) AS BIGINT) AS y1
FROM fx_landmarks l JOIN meta m ON l.clip_id = m.clip_id
JOIN c_kept k ON l.clip_id = k.clip_id AND l.frame = k.frame WHERE l.vis > 0.1e0
""")
part("c_edges", """
SELECT p.clip_id, p.frame, CAST(e.edge AS BIGINT) AS edge, e.color, p.x1, p.y1,
  q.x1 AS x2, q.y1 AS y2
FROM edges e JOIN c_joints p ON p.landmark = e.a
JOIN c_joints q ON q.landmark = e.b AND q.clip_id = p.clip_id AND q.frame = p.frame
""")
part("c_captions", """
SELECT clip_id, frame, 'angle' AS caption, printf('Lifter Angle: %.1f deg', lifter_angle_deg) AS text
FROM c_states WHERE lifter_angle_deg IS NOT NULL
UNION ALL SELECT clip_id, frame, 'time', printf('Time: %.2fs', time_s) FROM c_states
UNION ALL SELECT clip_id, frame, 'frame', 'Frame: ' || frame FROM c_states
""")

# --- statements, by query ----------------------------------------------------------------
_ROUNDED = {c: r(c) for c in ANALYSIS_TYPES if ANALYSIS_TYPES[c].typeName() == "double"}
for _c in ("vel_y_smooth", "accel_y_smooth", "specific_power_y_smooth"):
    _ROUNDED[_c] = r(_c, 4)


def analysis_columns(names=tuple(ANALYSIS_TYPES)) -> str:
    """Select list of analysis columns, doubles rounded."""
    return ", ".join(f"{_ROUNDED[c]} AS {c}" if c in _ROUNDED else c for c in names)


_REPORT = """
SELECT b.clip_id, '# Analysis Report: ' || upper(substr(b.lift_type, 1, 1)) || substr(b.lift_type, 2)
  || chr(10) || chr(10) || '## Phase Timing'
  || chr(10) || printf('- **First Pull:**  %.2fs', s1 - s0)
  || chr(10) || printf('- **Second Pull:** %.2fs', s2 - s1)
  || chr(10) || printf('- **Third Pull:**  %.2fs', s3 - s2)
  || chr(10) || printf('- **Recovery:**    %.2fs', s4 - s3)
  || chr(10) || printf('- **Total Time:**  %.2fs', s4 - s0)
  || chr(10) || chr(10) || '## Critique' || chr(10)
  || coalesce(f.lines, 'No major faults detected based on configured checks.') AS report
FROM border_times b LEFT JOIN (SELECT clip_id,
   string_agg('- ' || message, chr(10) ORDER BY ord) AS lines FROM fault_rows GROUP BY clip_id) f
  ON b.clip_id = f.clip_id
WHERE b.lift_type <> 'none' AND b.t0 IS NOT NULL
"""

STATEMENTS = {
    # sources and sinks
    "read_tracks": "SELECT * FROM fx_frames",
    "with_clip_metadata": """
        SELECT f.clip_id, f.frame, m.frame_width, m.frame_height, m.fps
        FROM fx_frames f JOIN meta m ON f.clip_id = m.clip_id""",
    "write_analysis": f"SELECT clip_id, frame, {analysis_columns()} FROM c_analysed",
    "import_analysis_csv": f"SELECT clip_id, frame, {analysis_columns()} FROM c_analysed",
    "landmark_text": f"""
        SELECT clip_id, frame, landmarks_str, CAST(12 AS BIGINT) AS n_points,
          left_vis AS left_hip_vis FROM (SELECT *, left_hip_vis AS left_vis FROM pose_wide) q""",
    "box_text": """
        SELECT clip_id, frame, det_id, printf('%.2f,%.2f,%.2f,%.2f', x1, y1, x2, y2) AS box_str,
          CAST(trunc(x1) AS BIGINT) AS x1, CAST(trunc(y1) AS BIGINT) AS y1,
          CAST(trunc(x2) AS BIGINT) AS x2, CAST(trunc(y2) AS BIGINT) AS y2 FROM fx_detections""",
    "write_report": _REPORT,
    # detection and shake
    "filter_detections": "SELECT * FROM wanted",
    "filter_detections_unknown_class": "SELECT * FROM wanted",
    "filter_detections_unnamed": "SELECT * FROM wanted",
    "clamp_boxes": "SELECT clip_id, frame, det_id, x1, y1, x2, y2, cx, cy FROM clamped",
    "feet_position": f"""
        SELECT clip_id, frame, {r("feet_x")} AS feet_x, {r("feet_y")} AS feet_y FROM feet""",
    "initial_endcap": """
        SELECT clip_id, frame, det_id, CASE WHEN by_feet THEN 'feet' ELSE 'center' END AS chosen_by,
          cx, cy FROM first_pick""",
    "track_endcap": "SELECT clip_id, frame, det_id, cx, cy, x1, y1, x2, y2 FROM walk",
    "pack_landmarks": """
        SELECT clip_id, frame, CAST(count(*) AS BIGINT) AS n_landmarks,
          max(CASE WHEN landmark = 'left_hip' THEN x END) AS left_hip_x,
          max(CASE WHEN landmark = 'right_wrist' THEN vis END) AS right_wrist_vis
        FROM fx_landmarks GROUP BY clip_id, frame""",
    "estimate_shake": "SELECT clip_id, frame, shake_dx, shake_dy FROM shake",
    "collect_frames": """
        SELECT clip_id, frame, barbell_x_raw, barbell_y_raw, shake_dx, shake_dy,
          x1 AS box_x1, y1 AS box_y1, x2 AS box_x2, y2 AS box_y2 FROM collected""",
    # frame enrichment
    "frame_gaps": "SELECT clip_id, frame_gaps FROM gaps",
    "unpack_landmarks": "SELECT clip_id, frame, " + ", ".join(
        f"{n}_{p}" for n in LANDMARKS for p in ("x", "y", "z", "vis")) + " FROM pose_wide",
    "unpack_landmark_map": "SELECT clip_id, frame, " + ", ".join(
        f"{n}_{p}" for n in LANDMARKS for p in ("x", "y", "z", "vis")) + " FROM pose_wide",
    "lifter_angle": f"SELECT clip_id, frame, {r('lifter_angle_deg')} AS lifter_angle_deg FROM pose",
    "pixel_coordinates": f"""
        SELECT l.clip_id, l.frame, l.landmark, {r("l.x * m.frame_width")} AS x_px,
          {r("l.y * m.frame_height")} AS y_px, {r("l.x")} AS x_norm, {r("l.y")} AS y_norm
        FROM fx_landmarks l JOIN meta m ON l.clip_id = m.clip_id""",
    "joint_angles": "SELECT clip_id, frame, " + ", ".join(
        f"{r(c)} AS {c}" for c in JOINT_POINTS) + " FROM pose",
    "hip_height": f"SELECT clip_id, frame, {r('hip_y_avg')} AS hip_y_avg FROM pose",
    "cumulative_shake": "SELECT clip_id, frame, total_shake_x, total_shake_y FROM shaken",
    "unpack_center": """
        SELECT clip_id, frame, barbell_x_raw, barbell_y_raw FROM collected""",
    "stabilize": f"""
        SELECT clip_id, frame, {r("barbell_x_stable")} AS barbell_x_stable,
          {r("barbell_y_stable")} AS barbell_y_stable FROM stable""",
    "truncate_at_peak": f"""
        SELECT clip_id, frame, {r("barbell_y_stable")} AS barbell_y_stable FROM kept""",
    "final_projection": f"SELECT clip_id, frame, {analysis_columns()} FROM analysed",
    "detection_rate": f"""
        SELECT clip_id, tracked_frames, total_frames, {r("detection_rate")} AS detection_rate
        FROM rates""",
    # kinematics
    "time_axis": f"SELECT clip_id, frame, {r('time_s')} AS time_s FROM timed",
    "frame_interval": f"SELECT clip_id, frame, {r('dt')} AS dt FROM timed",
    "bar_velocity": f"SELECT clip_id, frame, {r('vel_y_px_s')} AS vel_y_px_s FROM moving",
    "interpolate_velocity": f"SELECT clip_id, frame, {r('vel_filled')} AS vel_filled FROM filled",
    "smooth_velocity": f"""
        SELECT clip_id, frame, {r("vel_y_smooth", 4)} AS vel_y_smooth FROM smoothed""",
    "velocity_threshold": f"""
        SELECT DISTINCT clip_id, {r("vel_threshold", 4)} AS vel_threshold FROM accelerated""",
    "direction_state": "SELECT clip_id, frame, direction_state FROM directed",
    "phase_change": "SELECT clip_id, frame, phase_change FROM changed",
    "bar_phase": "SELECT clip_id, frame, bar_phase FROM phased",
    "acceleration": f"""
        SELECT clip_id, frame, {r("accel_y_smooth", 4)} AS accel_y_smooth FROM accelerated""",
    "specific_power": f"""
        SELECT clip_id, frame, {r("specific_power_y_smooth", 4)} AS specific_power_y_smooth
        FROM directed""",
    # charts
    "chart_series": f"""
        SELECT clip_id, metric, frame, {r("time_s")} AS time_s, {r("value", 4)} AS value
        FROM series""",
    "chart_extent": f"""
        SELECT clip_id, metric, {r("min(value)", 4)} AS min_value, {r("max(value)", 4)} AS max_value,
          min(value) < 0 AND max(value) > 0 AS zero_line FROM series GROUP BY clip_id, metric""",
    "chart_status": "SELECT clip_id, chart, points, status FROM charted",
    "skipped_charts": """
        SELECT clip_id, chart, points, status AS reason FROM charted WHERE status <> 'produced'""",
    "bar_path_segments": f"""
        SELECT r.clip_id, r.segment, p.frame, {r("p.x")} AS x, {r("p.y")} AS y, r.bar_phase,
          {_color_of.format("r.bar_phase")} AS color,
          CASE WHEN r.bar_phase % 3 = 1 THEN 'Phase (Down)' ELSE 'Phase (Up)' END AS label,
          CASE WHEN r.direction_state > 0 THEN 'up' ELSE 'down' END AS direction
        FROM c_runs r JOIN c_points p ON p.clip_id = r.clip_id AND p.pt BETWEEN r.a AND r.b + 1
        WHERE NOT (r.a = r.b AND r.b = r.n_points)""",
    "bar_path_markers": f"""
        SELECT a.clip_id, a.frame AS start_frame, {r("a.x")} AS start_x, {r("a.y")} AS start_y,
          b.frame AS end_frame, {r("b.x")} AS end_x, {r("b.y")} AS end_y
        FROM c_points a JOIN c_points b ON a.clip_id = b.clip_id AND b.pt = b.n_points
        WHERE a.pt = 1 AND a.n_points > 2""",
    # overlay
    "render_plan": "SELECT clip_id, frame FROM c_plan",
    "frame_state": f"""
        SELECT clip_id, frame, analysed, shake_x, shake_y,
          {r("lifter_angle_deg")} AS lifter_angle_deg, {r("time_s")} AS time_s, path_points
        FROM c_states""",
    "path_trail": f"""
        SELECT clip_id, segment, frame, {r("x1")} AS x1, {r("y1")} AS y1, {r("x2")} AS x2,
          {r("y2")} AS y2, color FROM c_trail""",
    "path_trail_last_frame": """
        SELECT s.clip_id, s.frame, t.segment, t.color,
          CAST(trunc(t.x1 + s.shake_x) AS BIGINT) AS x1, CAST(trunc(t.y1 + s.shake_y) AS BIGINT) AS y1,
          CAST(trunc(t.x2 + s.shake_x) AS BIGINT) AS x2, CAST(trunc(t.y2 + s.shake_y) AS BIGINT) AS y2
        FROM c_states s JOIN c_trail t ON s.clip_id = t.clip_id AND t.segment < s.path_points
        JOIN (SELECT clip_id, max(frame) AS frame FROM c_plan GROUP BY clip_id) l
          ON l.clip_id = s.clip_id AND l.frame = s.frame""",
    "box_primitives": "SELECT clip_id, frame, 'Barbell Box' AS color, x1, y1, x2, y2 FROM c_boxes",
    "skeleton_edges": "SELECT * FROM c_edges",
    "edge_colors": """
        SELECT clip_id, color, CAST(count(*) AS BIGINT) AS edges, CASE color
          WHEN 'Torso' THEN '255,255,0' WHEN 'Left Arm' THEN '0,165,255'
          WHEN 'Right Arm' THEN '0,255,255' WHEN 'Left Leg' THEN '255,0,128'
          ELSE '0,255,0' END AS bgr FROM c_edges GROUP BY clip_id, color""",
    "joint_points": "SELECT * FROM c_joints",
    "captions": "SELECT * FROM c_captions",
    "overlay": f"""
        SELECT clip_id, frame, 'shift' AS kind, NULL AS color, {r("shake_x")} AS x1,
          {r("shake_y")} AS y1, CAST(NULL AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS y2,
          CAST(path_points AS VARCHAR) AS text FROM c_states
        UNION ALL SELECT clip_id, frame, 'trail', color, {r("x1")}, {r("y1")}, {r("x2")}, {r("y2")},
          NULL FROM c_trail
        UNION ALL SELECT clip_id, frame, 'box', 'Barbell Box', x1, y1, x2, y2, NULL FROM c_boxes
        UNION ALL SELECT clip_id, frame, 'edge', color, x1, y1, x2, y2, NULL FROM c_edges
        UNION ALL SELECT clip_id, frame, 'joint', 'White', x1, y1, NULL, NULL, landmark FROM c_joints
        UNION ALL SELECT clip_id, frame, 'caption', 'White', NULL, NULL, NULL, NULL, text
          FROM c_captions""",
    # phases, faults, report
    "baseline_y": f"SELECT clip_id, {r('baseline_y')} AS baseline_y FROM based",
    "phase_t0": "SELECT m.clip_id, t0 FROM meta m LEFT JOIN begun b ON m.clip_id = b.clip_id",
    "phase_t1": "SELECT m.clip_id, t1 FROM meta m LEFT JOIN at_knees b ON m.clip_id = b.clip_id",
    "phase_t2": "SELECT m.clip_id, t2 FROM meta m LEFT JOIN turned b ON m.clip_id = b.clip_id",
    "phase_t3": "SELECT m.clip_id, t3 FROM meta m LEFT JOIN caught b ON m.clip_id = b.clip_id",
    "phase_t4": "SELECT m.clip_id, t4 FROM meta m LEFT JOIN topped b ON m.clip_id = b.clip_id",
    "lift_phases": "SELECT clip_id, t0, t1, t2, t3, t4 FROM bordered",
    "phase_slices": "SELECT clip_id, phase, frame FROM sliced",
    **{
        f"fault_{code.lower()}": f"""
        SELECT m.clip_id, coalesce(f.{code.lower()}, FALSE) AS {code.lower()}
        FROM meta m LEFT JOIN found_faults f ON m.clip_id = f.clip_id"""
        for code in FAULTS
    },
    "fault_sp_jump_px": """
        SELECT m.clip_id, coalesce(f.sp_jump_px, FALSE) AS sp_jump
        FROM meta m LEFT JOIN found_faults f ON m.clip_id = f.clip_id""",
    "faults": "SELECT clip_id, ord, code, message FROM fault_rows",
    "route_lift_type": """
        SELECT clip_id, lift_type, CASE lift_type WHEN 'none' THEN 'skip' WHEN 'clean' THEN 'faults'
          ELSE 'phases' END AS route FROM meta""",
    "phase_durations": f"""
        SELECT clip_id, {r("s1 - s0")} AS first_pull_s, {r("s2 - s1")} AS second_pull_s,
          {r("s3 - s2")} AS third_pull_s, {r("s4 - s3")} AS recovery_s, {r("s4 - s0")} AS total_s
        FROM border_times""",
    "critique_status": "SELECT * FROM statuses",
    "report_markdown": _REPORT,
    # whole runs
    "run_summary": "SELECT * FROM summed",
    "analyze_detections": "SELECT * FROM c_summed",
    "validate_tracks": """
        SELECT clip_id, CAST(count(*) AS BIGINT) AS n_frames, CAST(NULL AS VARCHAR) AS problem
        FROM fx_frames GROUP BY clip_id""",
    "track_endcap_stream": f"""
        SELECT f.clip_id, f.frame, w.det_id, w.cx, w.cy,
          {r("f.total_shake_x")} AS total_shake_x, {r("f.total_shake_y")} AS total_shake_y,
          {r("w.cx - f.total_shake_x")} AS barbell_x_stable,
          {r("w.cy - f.total_shake_y")} AS barbell_y_stable, CAST(0 AS BIGINT) AS late_frames
        FROM shaken f LEFT JOIN walk w ON f.clip_id = w.clip_id AND f.frame = w.frame""",
}
STATEMENTS["track_endcap_stream_bounded"] = STATEMENTS["track_endcap_stream"]

STATEMENTS["analyze_incremental"] = """
    SELECT clip_id, ord, code, message, CAST(CASE WHEN clip_id % 3 <> 0 THEN 0 ELSE 1 END AS BIGINT)
      AS run FROM fault_rows"""

STATEMENTS["clustered_join"] = f"""
    SELECT a.clip_id, CAST(count(*) AS BIGINT) AS frames,
      CAST(sum(CASE WHEN l.vis > 0.3e0 THEN 1 WHEN l.vis IS NOT NULL THEN 0 END) AS BIGINT) AS seen,
      {r("sum(l.y)")} AS ankle_y, {r("sum(a.barbell_y_stable)", 4)} AS bar_y
    FROM analysed a LEFT JOIN fx_landmarks l ON a.clip_id = l.clip_id AND a.frame = l.frame
      AND l.landmark = 'left_ankle' GROUP BY a.clip_id"""

# trails of all frames as polylines
def _trail_frames(top: int) -> str:
    return f"""
        SELECT s.clip_id, s.frame, s.level, s.number, s.number_of AS count,
          a.segment AS first_segment, b.segment AS last_segment,
          CAST(trunc(a.x1 + s.shake_x) AS BIGINT) AS x1, CAST(trunc(a.y1 + s.shake_y) AS BIGINT) AS y1,
          CAST(trunc(b.x2 + s.shake_x) AS BIGINT) AS x2, CAST(trunc(b.y2 + s.shake_y) AS BIGINT) AS y2
        FROM (SELECT clip_id, frame, shake_x, shake_y, CAST(l.level AS BIGINT) AS level,
            CAST(((path_points - 1) >> l.level) - 1 AS BIGINT) AS number,
            CAST(CASE WHEN l.level = {top} THEN (path_points - 1) >> {top} ELSE 1 END AS BIGINT) AS number_of
          FROM c_states JOIN (SELECT unnest(range(0, {top} + 1)) AS level) l
            ON path_points > 1 AND CASE WHEN l.level = {top} THEN (path_points - 1) >> {top} > 0
              ELSE ((path_points - 1) >> l.level) % 2 = 1 END) s
        JOIN c_trail a ON a.clip_id = s.clip_id AND a.segment = (s.number << s.level) + 1
        JOIN c_trail b ON b.clip_id = s.clip_id AND b.segment = (s.number + 1) << s.level"""


STATEMENTS["trail_frames"] = _trail_frames(10)
STATEMENTS["trail_frames_short"] = _trail_frames(3)
STATEMENTS["trail_all_frames"] = """
    SELECT s.clip_id, s.frame, CAST(count(*) AS BIGINT) AS segments,
      CAST(sum(trunc(t.x1 + s.shake_x)) AS BIGINT) AS sum_x1,
      CAST(sum(trunc(t.y1 + s.shake_y)) AS BIGINT) AS sum_y1,
      CAST(sum(trunc(t.x2 + s.shake_x)) AS BIGINT) AS sum_x2,
      CAST(sum(trunc(t.y2 + s.shake_y)) AS BIGINT) AS sum_y2
    FROM c_states s JOIN c_trail t ON s.clip_id = t.clip_id AND t.segment < s.path_points
    GROUP BY s.clip_id, s.frame"""

# the stream without some frames, which come late
part("g_frames", """
SELECT f.clip_id, f.frame, f.shake_dx, f.shake_dy, f.frame % 17 = 5 AND f.frame < l.frame AS late
FROM fx_frames f JOIN (SELECT clip_id, max(frame) AS frame FROM fx_frames GROUP BY clip_id) l
  ON f.clip_id = l.clip_id
""")
part("g_cands", """
SELECT c.* EXCLUDE (step), dense_rank() OVER (PARTITION BY c.clip_id ORDER BY c.frame) AS step
FROM cands c JOIN g_frames f ON c.clip_id = f.clip_id AND c.frame = f.frame WHERE NOT f.late
""")
part("g_walk", """
SELECT clip_id, frame, step, det_id, cx, cy FROM (SELECT *, row_number() OVER (
   PARTITION BY clip_id ORDER BY first_key, det_id) AS place FROM g_cands WHERE step = 1) q
WHERE place = 1
UNION ALL
SELECT clip_id, frame, step, det_id, cx, cy FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.clip_id ORDER BY
    (c.cx - w.cx)*(c.cx - w.cx) + (c.cy - w.cy)*(c.cy - w.cy), c.det_id) AS place
  FROM g_walk w JOIN g_cands c ON c.clip_id = w.clip_id AND c.step = w.step + 1) q
WHERE place = 1
""")
part("g_shaken", """
SELECT *, sum(CASE WHEN late THEN 0 ELSE shake_dx END) OVER up AS sx,
  sum(CASE WHEN late THEN 0 ELSE shake_dy END) OVER up AS sy
FROM (SELECT * FROM g_frames) q
WINDOW up AS (PARTITION BY clip_id ORDER BY late, frame)
""")
STATEMENTS["track_endcap_stream_gaps"] = f"""
    SELECT f.clip_id, f.frame, w.det_id, w.cx, w.cy, {r("f.sx")} AS total_shake_x,
      {r("f.sy")} AS total_shake_y, {r("w.cx - f.sx")} AS barbell_x_stable,
      {r("w.cy - f.sy")} AS barbell_y_stable, f.late
    FROM g_shaken f LEFT JOIN g_walk w ON f.clip_id = w.clip_id AND f.frame = w.frame"""
part("raw_shaken", """
SELECT clip_id, frame, sum(shake_dx) OVER up AS sx, sum(shake_dy) OVER up AS sy
FROM shake WINDOW up AS (PARTITION BY clip_id ORDER BY frame)
""")
STATEMENTS["track_endcap_raw_stream"] = f"""
    SELECT f.clip_id, f.frame, w.det_id, w.cx, w.cy, {r("f.sx")} AS total_shake_x,
      {r("f.sy")} AS total_shake_y, {r("w.cx - f.sx")} AS barbell_x_stable,
      {r("w.cy - f.sy")} AS barbell_y_stable, CAST(0 AS BIGINT) AS late_frames
    FROM raw_shaken f LEFT JOIN walk w ON f.clip_id = w.clip_id AND f.frame = w.frame"""


# --- the rough fleet: other inputs below the same steps ------------------------------------
ROUGH = {
    "plain_clips": PARTS["fx_clips"], "plain_frames": PARTS["fx_frames"],
    "plain_landmarks": PARTS["fx_landmarks"],
    "met": PARTS["fx_detections"].replace("fx_frames", "plain_frames"),
    "orphans": """
SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT d.clip_id, d.frame FROM met d
  JOIN fx_clips c ON d.clip_id = c.clip_id
  LEFT JOIN fx_frames f ON d.clip_id = f.clip_id AND d.frame = f.frame
  WHERE f.frame IS NULL AND d.class_name = 'endcap' AND d.conf >= 0.25e0) q""",
    "all_clips": """
SELECT clip_id, frame_width, frame_height, CASE WHEN clip_id % 7 = 3 THEN 0e0 ELSE fps END AS fps,
  total_frames, lift_type FROM plain_clips""",
    "all_frames": """
SELECT clip_id, frame, CASE WHEN clip_id % 7 = 6 THEN NULL ELSE barbell_x_raw END AS barbell_x_raw,
  CASE WHEN clip_id % 7 = 6 OR barbell_y_raw IS NULL THEN NULL WHEN clip_id % 7 = 2 THEN 918e0
    ELSE barbell_y_raw END AS barbell_y_raw, shake_dx, shake_dy
FROM plain_frames JOIN (VALUES (1), (2)) t(time)
  ON t.time = 1 OR (clip_id % 7 = 4 AND frame = 10)
WHERE clip_id % 7 <> 5 AND (clip_id % 14 <> 13 OR frame < 2)""",
    "counted": """
SELECT clip_id, sum(n) AS n, max(n) AS most FROM (
  SELECT clip_id, frame, count(*) AS n FROM all_frames GROUP BY clip_id, frame) q
GROUP BY clip_id""",
    "judged": """
SELECT c.clip_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_frames,
  CASE WHEN f.n IS NULL THEN 'no_frames' WHEN coalesce(c.fps, 30e0) <= 0 THEN 'bad_fps'
    WHEN f.most > 1 THEN 'duplicate_frame' END AS problem
FROM all_clips c LEFT JOIN counted f ON c.clip_id = f.clip_id""",
    "fx_clips": """
SELECT * FROM all_clips WHERE clip_id IN (SELECT clip_id FROM judged WHERE problem IS NULL)""",
    "fx_frames": """
SELECT * FROM all_frames WHERE clip_id IN (SELECT clip_id FROM judged WHERE problem IS NULL)""",
    "fx_landmarks": """
SELECT clip_id, frame, landmark, x, CASE WHEN clip_id % 7 = 1 AND landmark LIKE '%ankle'
  THEN y - 4 * least(greatest(frame - 24, 0), 20) / 1000e0 ELSE y END AS y, z, vis
FROM plain_landmarks WHERE (clip_id % 14 <> 13 OR frame < 2)
  AND clip_id IN (SELECT clip_id FROM judged WHERE problem IS NULL)""",
}
ROUGH_STATEMENTS = {
    "validate_tracks_rough": "SELECT clip_id, n_frames, problem FROM judged",
    "empty_columns_rough": "\nUNION ALL ".join(
        f"SELECT clip_id, '{c}' AS \"column\" FROM analysed GROUP BY clip_id "
        + ("" if c == "right_shoulder_y" else f"HAVING count({c}) = 0")
        for c in ("barbell_y_stable", "hip_y_avg", "left_knee_y", "right_knee_y",
                  "left_shoulder_y", "right_shoulder_y", "frame_height", "time_s")),
    "run_counts": """
        SELECT 'clips' AS source, 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM all_clips
        UNION ALL SELECT 'clips', 'rows_with_nan', 0
        UNION ALL SELECT 'frames', 'rows', count(*) FROM all_frames
        UNION ALL SELECT 'frames', 'rows_with_nan', count(*) FROM all_frames WHERE frame % 10 = 7
        UNION ALL SELECT 'landmarks', 'rows', count(*) FROM plain_landmarks
          WHERE clip_id % 7 <> 5 AND (clip_id % 14 <> 13 OR frame < 2)
        UNION ALL SELECT 'landmarks', 'rows_with_nan', 0
        UNION ALL SELECT 'detections', 'rows', count(*) FROM met
        UNION ALL SELECT 'detections', 'rows_with_nan', 0
        UNION ALL SELECT 'clips', problem, count(*) FROM judged WHERE problem IS NOT NULL GROUP BY problem
        UNION ALL SELECT 'tracked', 'rows', (SELECT count(*) FROM fx_frames) + n FROM orphans
        UNION ALL SELECT 'tracked', 'orphan_detections', n FROM orphans""",
    "analyze_quarantined": """
        SELECT clip_id, n_frames, problem FROM judged WHERE problem IS NOT NULL""",
    **{name: STATEMENTS[plain] for name, plain in {
        **{f"{q}_rough": q for q in (
            "chart_status", "skipped_charts", "lift_phases", "fault_sp_jump", "fault_sp_jump_px",
            "critique_status", "final_projection")},
        "analyze_faults": "faults", "analyze_status": "critique_status",
        "analyze_skipped_charts": "skipped_charts", "analyze_report": "report_markdown",
        "analyze_run_summary": "run_summary"}.items()},
}


def all_sql() -> dict[str, str]:
    rough = PARTS | {name: text.strip() for name, text in ROUGH.items()}
    return ({name: sql(statement) for name, statement in STATEMENTS.items()}
            | {name: sql(statement, rough) for name, statement in ROUGH_STATEMENTS.items()})
