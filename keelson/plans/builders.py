"""Record construction and the dataset recipes built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy
from ..functions import confidence as C
from ..functions import geometry as G
from ..functions import text as X
from ..operators import aggregates, sampling
from ..scratch import stored

# --- Fixed values: prompts and templates. ---
IDENTIFY = """This is an image containing a ship. Please identify the model of the ship based on the image.
Output the thinking process in <think> </think> and final answer in <answer> </answer> tags.
The output answer format should be as follows:
<think> ... </think> <answer>species name</answer>
Please strictly follow the format."""
IDENTIFY_LISTED = """This is an image containing a ship. Please identify the type of the ship based on the image.

You can ONLY output ONE of these exact answers:
{classes}, unknown

Rules:
- If the ship matches one of the 14 known types → output that exact type name
- If the ship does NOT match ANY of the 14 types → output "unknown"

Output the thinking process in <think> </think> and final answer in <answer> </answer> tags.
The output answer format should be as follows:
<think> ... </think> <answer>type</answer>
Please strictly follow the format."""
IDENTIFY_QUOTED = """This is an image containing a ship. Please identify the species of the ship based on the image.

You must compare it against the following known ship types: '{classes}'.

IMPORTANT:
- If you are CERTAIN it matches one of the types, output in JSON format: {"category": "type_name", "ood": false}
- If you are UNCERTAIN or it doesn't clearly match any type, output: {"ood": true, "category": "unknown"}

Output the thinking process in <think> </think> and final answer in <answer> </answer> tags.
The output format should be:
<think> ... </think> <answer>{"category": "ship_type", "ood": false}</answer>"""
DETECT = """Detect all objects belonging to the category '{cls}' in the image, and provide the bounding boxes (between 0 and 1000, integer) and confidence (between 0 and 1, with two decimal places).
If no object belonging to the category '{cls}' in the image, return 'No Objects'.
Output the thinking process in <think> </think> and final answer in <answer> </answer> tags.The output answer format should be as follows:
<think> ... </think> <answer>[{'Position': [x1, y1, x2, y2], 'Confidence': number}, ...]</answer>
Please strictly follow the format."""
IDENTIFIED = "Based on the ship's characteristics visible in the image, I can identify this as a {category}."
ID_THOUGHTS = [
    "This vessel shows typical features of a {category}.",
    "Based on the hull shape and structure, this appears to be a {category}.",
    "The visual characteristics match a {category}.",
    "Analyzing the ship's features, I identify this as a {category}.",
    "This ship has distinctive features of a {category}.",
]
OOD_THOUGHTS = [
    "This vessel does not match any of the 14 known ship types.",
    "The features of this ship do not correspond to any known category.",
    "This appears to be a ship type outside the known categories.",
    "I cannot identify this vessel as any of the 14 known types.",
    "This ship's characteristics do not fit any known category.",
]
# --- End of fixed values. ---


def tagged(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))


def answer_solution(category: Column, known: Column | None = None) -> Column:
    """Answer tag alone; rows that aren't ``known`` answer ``unknown``."""
    return tagged("answer", category if known is None else F.when(known, category).otherwise("unknown"))


def plain_solution(category: Column) -> Column:
    """The class name alone, without tags."""
    return category


def class_list(*parts: Column) -> Column:
    """Class lists one after the other, repeats kept."""
    return F.concat(*parts)


def filled(template: str, category: Column, name: str = "category") -> Column:
    return F.replace(F.lit(template), F.lit("{" + name + "}"), category)


def think_solution(category: Column, template: str = IDENTIFIED) -> Column:
    return F.concat_ws(" ", tagged("think", filled(template, category)), tagged("answer", category))


def empty_confidence_solution(category: Column) -> Column:
    return F.concat_ws(" ", tagged("confidence", F.lit("")), think_solution(category))


def confidence_solution(category: Column, value: Column, known: Column) -> Column:
    """Answer and confidence: shortest form for known rows, two decimals for the others."""
    number = F.when(known, value.cast("string")).otherwise(X.two_digits(value))
    return F.concat_ws(" ", answer_solution(category, known), tagged("confidence", number))


def varied_think_solution(category: Column, known: Column, key: Column, seed: int = sampling.SEED) -> Column:
    """One of five thoughts by a hash of the key; underscores become spaces in thoughts on known rows."""
    pick = F.floor(C.uniform(seed, key, "thought") * 5).cast("int")
    plain = F.replace(category, F.lit("_"), F.lit(" "))
    thought = F.when(known, F.get(F.array(*[filled(t, plain) for t in ID_THOUGHTS]), pick)).otherwise(F.get(F.array(*map(F.lit, OOD_THOUGHTS)), pick))
    return F.concat_ws(" ", tagged("think", thought), answer_solution(category, known))


def prompt_with_classes(names: list[str], quoted: bool = False) -> str:
    """Prompt with the class list, comma-joined or quoted."""
    return (IDENTIFY_QUOTED if quoted else IDENTIFY_LISTED).replace("{classes}", ("', '" if quoted else ", ").join(names))


def prompt_from_table(classes: DataFrame, template: str, separator: str = ", ") -> DataFrame:
    """The same from a class table ``(category, ordinal)``: one row with ``problem``."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "category"))), lambda s: s["category"])
    return classes.agg(filled(template, F.array_join(names, separator), "classes").alias("problem"))


def detection_prompt(category: Column) -> Column:
    return filled(DETECT, category, "cls")


def task_prompt(task: Column, category: Column, answer: Column, prompts: dict[str, str]) -> Column:
    """Prompt by task name; ``{category}`` and ``{answer}`` are filled in.  Null for an unknown task."""
    out = F.lit(None).cast("string")
    for name, template in prompts.items():
        text = F.replace(filled(template, category), F.lit("{answer}"), answer)
        out = F.when(task == name, text).otherwise(out)
    return out


def thought_solution(thought: Column, solution: Column) -> Column:
    """Generated thought before the original answer, in a solution tag; just the original where there is no thought."""
    both = F.concat_ws("\n", X.tag_with_marks(thought, "think"), X.tag_with_marks(solution, "answer"))
    return F.when(X.tag_with_marks(thought, "think").isNotNull(), tagged("solution", both)).otherwise(solution)


def metadata_json(**fields: Column) -> Column:
    """JSON object of the given fields; nulls are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def result_row(answer: Column, truth: Column, error: Column) -> list[Column]:
    """Columns of an inference result."""
    ok = F.coalesce(X.matches_either_way(X.normalised(answer), X.normalised(truth)), F.lit(False))
    return [truth.alias("truth"), answer.alias("answer"), (ok & error.isNull()).alias("is_correct"), F.left(error, F.lit(120)).alias("error")]


def records(df: DataFrame, image: str, problem: Column, solution: Column, metadata: Column | None = None) -> DataFrame:
    extra = [] if metadata is None else [metadata.alias("metadata")]
    return df.select(F.col(image).alias("image"), problem.alias("problem"), solution.alias("solution"), *extra)


def kshot_answers(items: DataFrame, shots: int, seed: int = sampling.SEED) -> DataFrame:
    """k-shot training records with answers alone, from ``items(path, category)``."""
    shot = sampling.k_shot(items, "category", "path", shots, seed)
    return records(shot, "path", F.lit(IDENTIFY), answer_solution(F.col("category")), metadata_json(type=F.lit("ID"), category=F.col("category")))


def kshot_thoughts(items: DataFrame, shots: int, confidence_tag: bool = False, seed: int = sampling.SEED) -> DataFrame:
    """k-shot records with a thought, optionally behind an empty confidence tag."""
    shot = sampling.k_shot(items, "category", "path", shots, seed)
    solution = (empty_confidence_solution if confidence_tag else think_solution)(F.col("category"))
    return records(shot, "path", F.lit(IDENTIFY), solution, metadata_json(type=F.lit("ID"), category=F.col("category")))


def open_set(items: DataFrame, shots: int, scheme: str = "destroyer_id", seed: int = sampling.SEED) -> DataFrame:
    """k-shot known records and a balanced sample of unknown ones, by the shot configuration."""
    roles = taxonomy.SCHEMES[scheme]
    ratio, least, coverage = taxonomy.SHOT_CONFIGS.get(shots, taxonomy.DEFAULT_SHOT_CONFIG)
    n_id = len(roles["id"]) * shots
    target = max(int(n_id * ratio / (1 - ratio)), least)
    level = {c: name for name, cs in taxonomy.DIFFICULTY.items() for c in cs}
    known = sampling.k_shot(items.where(F.col("category").isin(roles["id"])), "category", "path", shots, seed)
    known = known.select("path", "category", F.lit(True).alias("known"))
    other = sampling.balanced_sample(items.where(F.col("category").isin(roles["ood_train"])), "category", "path", target, coverage, len(roles["ood_train"]), seed)
    both = known.unionByName(other.select("path", "category", F.lit(False).alias("known")))
    hard = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in level.items() for x in kv]), F.col("category")), F.lit("Unknown"))
    c, unknown = F.col("category"), ~F.col("known")
    meta = metadata_json(
        type=F.when(unknown, "OOD").otherwise("ID"),
        category=F.when(unknown, "unknown").otherwise(c),
        original_category=c,
        ood_split=F.when(unknown, "train"),
        difficulty=F.when(unknown, hard),
    )
    return records(both, "path", F.lit(IDENTIFY), answer_solution(c, F.col("known")), meta)


def open_set_listed(items: DataFrame, shots: int, ood_share: float = 0.3, scheme: str = "tugboat_id", varied: bool = False, seed: int = sampling.SEED) -> DataFrame:
    """Known k-shot and equal quotas of unknown classes, with the class list in the prompt."""
    roles = taxonomy.SCHEMES[scheme]
    target = int(len(roles["id"]) * shots * ood_share / (1 - ood_share))
    known = sampling.k_shot(items.where(F.col("category").isin(roles["id"])), "category", "path", shots, seed).withColumn("known", F.lit(True))
    other = items.where(F.col("category").isin(roles["ood_train"]))
    other = sampling.equal_quota_sample(other, "category", "path", target, len(roles["ood_train"]), seed).withColumn("known", F.lit(False))
    both = known.unionByName(other)
    c, k = F.col("category"), F.col("known")
    solution = varied_think_solution(c, k, F.col("path"), seed) if varied else answer_solution(c, k)
    return records(both, "path", F.lit(prompt_with_classes(roles["id"])), solution)


def osr_rows(known: DataFrame, other: DataFrame, shots: int, seed: int = sampling.SEED, noise: bool = False) -> DataFrame:
    """Known rows with ranked confidences and roles; unknown rows from ``other(path, category, similarity, closest)`` under the running budget.

    With ``noise`` the confidence targets of unknown rows vary normally, by a hash of the path.
    """
    per_class = int(shots * taxonomy.osr_multiplier(shots))
    cap = known.agg(F.floor(F.count_distinct("category") * shots * 0.5))
    ids = sampling.k_shot(known, "category", "path", shots, seed).join(sampling.class_counts(known, "category"), "category")
    used = F.least(F.col("n"), F.lit(shots))
    ids = ids.withColumn("confidence", C.id_confidence(F.col("rn"), used, C.uniform(seed, F.col("path"), "id")))
    ids = ids.withColumn("split", F.when(F.col("rn") <= F.floor(used / 2), "support").otherwise("query"))
    ood = sampling.budgeted_sample(other, "category", "path", per_class, cap, seed)
    s = F.col("similarity")
    target = C.pseudo_confidence(s, F.col("category").isin(taxonomy.HARD_OOD), C.normal(seed, F.col("path")) if noise else None)
    none = F.lit(None)
    only_ood = {"pseudo_ood_score": (C.ood_score(s), "double"), "closest_id": (F.col("closest"), "string"), "max_similarity": (s, "double"), "difficulty": (C.difficulty(s), "string")}
    left = ids.select("path", "category", F.lit(True).alias("known"), "confidence", "split", *(none.cast(t).alias(c) for c, (_, t) in only_ood.items()))
    right = ood.select("path", "category", F.lit(False).alias("known"), target.alias("confidence"), F.lit("query").alias("split"), *(x.cast(t).alias(c) for c, (x, t) in only_ood.items()))
    both = left.unionByName(right)
    meta = metadata_json(type=F.when(F.col("known"), "ID").otherwise("OOD"), category=F.col("category"), confidence_target=F.col("confidence"), **{c: F.col(c) for c in only_ood}, split=F.col("split"))
    return records(both, "path", F.lit(IDENTIFY), confidence_solution(F.col("category"), F.col("confidence"), F.col("known")), meta)


def detection_records(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``(image, problem, solution)`` with the boxes of each image's main class; images without annotations are left out.

    ``images(image_id, file_name, width, height)``, ``annotations(annotation_id,
    image_id, category_id, bbox as x, y, w, h)``, ``categories(category_id, name)``.
    """
    main = aggregates.main_class(annotations, "image_id", "category_id", "annotation_id")
    kept = annotations.join(main.select("image_id", "category_id"), ["image_id", "category_id"]).join(images, "image_id")
    at = lambda i: F.get("bbox", i)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    corners = F.array(G.scaled_1000(at(0), w), G.scaled_1000(at(1), h), G.scaled_1000(at(0) + at(2), w), G.scaled_1000(at(1) + at(3), h))
    box = F.struct(corners.alias("Position"), F.lit(1.0).alias("Confidence"))
    listed = kept.groupBy("image_id", "category_id", "file_name").agg(F.sort_array(F.collect_list(F.struct("annotation_id", box.alias("box")))).alias("b"))
    named = listed.join(categories, "category_id")
    boxes = F.transform("b", lambda s: s["box"])
    return named.select(F.col("file_name").alias("image"), detection_prompt(F.col("name")).alias("problem"), tagged("answer", X.boxes_or_none(boxes)).alias("solution"))


def coco_from_voc(boxes: DataFrame, ordered_by: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories from VOC boxes; categories are numbered by name or by first appearance.

    The boxes are kept in a table of the shared folder, so the files are read once.
    """
    from ..operators.windows import first_seen_ids, sorted_ids

    boxes = stored(boxes, "boxes")  # read once
    images = stored(sorted_ids(boxes, "filename", "image_id"), "images")
    placed = boxes.join(images, "filename")
    order = F.struct("image_id", "pos")
    cats = stored(sorted_ids(boxes, "name", "category_id") if ordered_by == "name" else first_seen_ids(placed.withColumn("_o", order), "name", "_o", "category_id"), "categories")
    numbered = sampling.with_position(placed, ["image_id", "pos"], sampling.range_bucket(images, "image_id"), "annotation_id").join(cats, "name")
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    out = numbered.select("annotation_id", "image_id", "category_id", G.corners_to_xywh(*(F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"), G.area(w, h).alias("area"))
    return images, out, cats


# --- tasks by name -----------------------------------------------------------------

#: What a task asks for; a user's own tasks join by :func:`register_task`.
TASKS: dict[str, str] = {"classification": IDENTIFY, "detection": DETECT.replace("{cls}", "{category}")}


def register_task(name: str, template: str) -> None:
    """Add a prompt template, with ``{category}`` and ``{answer}`` to be filled in."""
    TASKS[name] = template


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    """Row-wise map by column expressions; rows where one of them is null go."""
    return df.withColumns(columns).dropna(subset=list(columns))


def preflight(shots: int, seed: str, devices: int, **required: str | None) -> list[str]:
    """What is wrong with the settings of a run; empty if nothing is."""
    wrong = [f"{name} is not set" for name, value in required.items() if not value]
    if shots not in (4, 8):
        wrong.append("shots has to be 4 or 8")
    if not seed.isdigit():
        wrong.append("seed has to be a whole number")
    if devices < 1:
        wrong.append("no device")
    return wrong
