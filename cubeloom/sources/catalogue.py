"""The conversion of each annotation source to samples.

QA_SOURCES are data: how a video's key and category follow from the annotation, what happens to a
miss, and which texts make the prompt. The other sources have rules of their own, put together from the
operators. All take annotations and a catalogue or listing of media; decoders are callables that are given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.convert import hash_choice, qa_to_dialogues, qa_to_one_dialogue, relative_times, turn, uid
from ..operators.hygiene import admitted, first_whole_caption, routed, valid_frames, without_last_image
from ..operators.joins import by_priority, last_files, lookup
from .external import with_frames


@dataclass(frozen=True)
class SourceSpec:
    """prefix, and SQL over ``video`` for the sample's category and the catalogue's key. miss: skip or abort. form: the prompt, i, q or iq."""

    name: str
    prefix: str
    category: str
    key: str
    miss: str
    form: str


_NAME, _FIRST, _SECOND = "element_at(split(video, '/'), -1)", "split(video, '/')[0]", "split(video, '/')[1]"
QA_SOURCES = {
    s.name: s
    for s in (
        SourceSpec("textvr", "VideoChat2IT_TextVR", _FIRST, "video", "abort", "i"),
        SourceSpec("kinetics710", "VideoChat2IT_Kinetics710", _SECOND, f"concat({_SECOND}, '/', {_NAME})", "skip", "iq"),
        SourceSpec("nextqa", "VideoChat2IT_NextQA", _FIRST, _SECOND, "abort", "iq"),
        SourceSpec("clevrer_qa", "VideoChat2IT_ClevrerQA", "'ClevrerQA'", "video", "abort", "iq"),
        SourceSpec("clevrer_mc", "VideoChat2IT_ClevrerMC", "'ClevrerMC'", "video", "abort", "iq"),
        SourceSpec("egoqa", "VideoChat2IT_EgoQA", f"concat({_FIRST}, '_', {_SECOND})", "video", "skip", "iq"),
        SourceSpec("tgif_frame", "VideoChat2IT_TGIFFrameQA", "'TGIFFrameQA'", "video", "abort", "q"),
        SourceSpec("tgif_transition", "VideoChat2IT_TGIFTransitionQA", "'TGIFTransitionQA'", "video", "abort", "iq"),
        SourceSpec("sharegptvideo_vqa", "VideoChat2IT_ShareGPTVideoVQA", "'ShareGPTVideoVQA'", "concat(video, '.mp4')", "skip", "iq"),
        SourceSpec("sharegptvideo_caption", "VideoChat2IT_ShareGPTVideoCaption", "'ShareGPTVideoCaption'", "concat(video, '.mp4')", "skip", "i"),
        SourceSpec("videochat2", "VideoChat2IT_VideoChat2", "'VideoChat2'", "video", "skip", "q"),
    )
}
CAPTION_ROUTES = {"caption_storyline": ("Caption", "Storyline"), "qa_climax": ("QA", "Climax")}


def _samples(df: DataFrame, id_: Column, kind: str = "conversations") -> DataFrame:
    return df.withColumns({"uid": id_, "data_type": F.lit(kind)})


def qa_source(spec: SourceSpec, annotations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A dialogue for each question. annotations: i (the running number), video, QA (array of i, q, a). catalogue: key and path."""
    rows = lookup(annotations.withColumns({"_category": F.expr(spec.category), "key": F.expr(spec.key)}), catalogue, ["key"], spec.miss)
    rows = qa_to_dialogues(rows, "QA", spec.form, tag="").withColumn("video", F.col("path"))
    return _samples(rows, uid(spec.prefix, F.col("_category"), F.col("i"))).drop("_category", "key", "path")


def videochatgpt(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """As qa_source; files (stem, suffix, path) of either suffix, .mkv rather than .mp4."""
    rows = annotations.withColumns({"_name": F.expr(_NAME), "stem": F.expr(f"regexp_replace({_NAME}, '[.][^.]*$', '')")})
    rows = by_priority(rows, files, "stem", "suffix", [".mkv", ".mp4"])
    rows = qa_to_dialogues(rows, "QA", "q", tag="").withColumn("video", F.col("path"))
    return _samples(rows, uid("VideoChat2IT_VideoChatGPT", F.concat(F.lit("train_"), "_name"), F.col("i"))).drop("_name", "stem", "suffix", "path")


def youcook2(annotations: DataFrame, listing: DataFrame, segments: DataFrame, decode: Callable) -> DataFrame:
    """Clips. video is split/recipe/name/name_k.ext; listing (folder, file); segments (name, id, start, stop) must have the k-th of the name.

    The file is the last in the folder whose name contains the video's. The clip's name has its end twice, as published."""
    part = lambda n: F.split("video", "/")[n]
    folder, name = F.concat_ws("/", part(0), part(1)), part(2)
    number = F.regexp_extract(part(3), r".*?_(\d+)\..*", 1).cast("int")
    files = last_files(annotations.select(folder.alias("folder"), name.alias("name")), listing, "name", "file", within=("folder",))
    # Keys follow from video, so that rows are dealt out without them and have them made behind the shuffle.
    rows = annotations.repartition(folder, name).withColumns({"folder": folder, "name": name})
    rows = lookup(rows, files, ["folder", "name"], "skip").drop("folder", "name")
    rows = rows.repartition(name, number).withColumns({"name": name, "id": number})
    rows = lookup(rows, segments, ["name", "id"], "abort").drop("name", "id")
    rows = with_frames(qa_to_dialogues(rows, "QA", "i", tag=""), decode, [F.concat_ws("/", folder, "file"), F.col("start"), F.col("stop")])
    clip = F.concat(F.lit("_"), F.col("stop").cast("string"), F.lit(":"), F.col("stop").cast("string"))
    rows = rows.withColumns({"_uid": F.concat_ws("_", part(0), part(1), part(2), part(3)), "video": F.replace(F.concat_ws("/", folder, "file"), name, F.concat(name, clip)), "timestamps": relative_times(F.col("timestamps"), F.col("start"))})
    return _samples(rows, uid("VideoChat2IT_YouCook2", F.col("_uid"), F.col("i"))).drop("file", "start", "stop", "_uid")


def webvid(annotations: DataFrame, catalogue: DataFrame, decode: Callable) -> DataFrame:
    """One dialogue of all instructions; videos of less than two frames are left out."""
    rows = lookup(annotations, catalogue, ["video"], "skip").withColumn("conversations", qa_to_one_dialogue(F.col("QA"), tag="")).drop("QA")
    rows = with_frames(rows.withColumn("video", F.col("path")).drop("path"), decode, [F.col("video")], least=2)
    return _samples(rows, F.concat(F.lit("WebVid400K_"), F.col("i").cast("string")))


def anet_captions(annotations: DataFrame, catalogue: DataFrame, decode: Callable) -> DataFrame:
    """annotations: video and sentences, which are joined to the caption."""
    rows = lookup(annotations, catalogue, ["video"], "skip")
    rows = with_frames(rows, decode, [F.col("path")]).withColumn("caption", F.array_join("sentences", " "))
    return _samples(rows, F.concat(F.lit("ANetCaptions_"), "video"), "caption").withColumn("video", F.col("path")).drop("path", "sentences")


def sharegpt4video(annotations: DataFrame, catalogue: DataFrame, decode: Callable) -> DataFrame:
    """annotations: i, video, zip_folder and captions (idx, content), of which the whole video's is taken; without one the row is left out."""
    rows = annotations.withColumn("caption", first_whole_caption(F.col("captions"))).where("caption IS NOT NULL")
    rows = with_frames(lookup(rows, catalogue, ["video"], "skip"), decode, [F.col("path")])
    category = F.regexp_replace(F.element_at(F.split("zip_folder", "/"), -1), "[.][^.]*$", "")
    return _samples(rows, uid("ShareGPT4Video", category, F.col("i")), "caption").withColumn("video", F.col("path")).drop("path", "captions", "zip_folder")


def finevideo(samples: DataFrame, catalogue: DataFrame, decode: Callable) -> DataFrame:
    """samples: uid, video, conversations. Adds category by uid and first prompt, and route, the file that it goes to."""
    rows = with_frames(lookup(samples.withColumn("name", F.expr(_NAME)), catalogue, ["name"], "skip"), decode, [F.col("path")])
    first, qa = F.col("conversations")[0]["value"], F.col("uid").contains("qAndA")
    category = F.when(qa, "QA").when(first.startswith("Please locate the timestamp"), "Climax").when(first.startswith("Please provide a general outline of the storyline"), "Storyline").otherwise("Caption")
    return rows.drop("name", "path").withColumn("category", category).withColumn("route", routed(F.col("category"), CAPTION_ROUTES))


def moviechat(annotations: DataFrame, folder: str, templates: list[str]) -> DataFrame:
    """A caption's dialogue and one for each question. annotations: i, name, caption, QA (question, answer). Missing videos are kept."""
    shared = annotations.withColumn("video", F.concat(F.lit(folder), "name", F.lit(".mp4")))
    pair = lambda q, a: F.array(turn("human", q), turn("gpt", a))
    caption = shared.withColumns({"conversations": pair(hash_choice(templates, F.col("name")), F.col("caption")), "_kind": F.lit("caption")})
    asked = shared.withColumn("_qa", F.explode("QA")).withColumns({"conversations": pair(F.col("_qa.question"), F.col("_qa.answer")), "_kind": F.lit("qa")}).drop("_qa")
    rows = caption.unionByName(asked)
    return _samples(rows, uid("MovieChat", F.concat_ws("_", "name", "_kind"), F.col("i"))).drop("name", "caption", "QA", "_kind")


def longvila(annotations: DataFrame, catalogue: DataFrame, low: int = 2, high: int = -1) -> DataFrame:
    """annotations: i, id, conversations; catalogue: id, path, frames. Each human turn loses its first <video> and the space before it."""
    rows = lookup(annotations, catalogue, ["id"], "skip").where(valid_frames(F.col("frames"), low, high))
    at = lambda v: F.locate("<video>", v)
    cut = lambda v: F.concat(F.regexp_replace(F.substring(v, F.lit(1), at(v) - 1), r"\s+$", ""), F.substring(v, at(v) + 7, F.length(v)))
    kept = F.transform("conversations", lambda t: turn_of(t["from"], F.when((t["from"] == "human") & t["value"].contains("<video>"), cut(t["value"])).otherwise(t["value"])))
    return _samples(rows.withColumn("conversations", kept), uid("LongVilaSFT", F.col("id"), F.col("i"))).withColumn("video", F.col("path")).drop("id", "path", "frames")


def turn_of(role: Column, value: Column) -> Column:
    return F.struct(role.alias("from"), value.alias("value"))


def llava_pretrain(samples: DataFrame, folder: str, images: DataFrame) -> DataFrame:
    """samples: image and conversations; those whose image is listed (images: image, with its folder)."""
    rows = samples.withColumn("image", F.concat(F.lit(folder), "image"))
    return rows.join(images, "image", "left_semi").withColumn("data_type", F.lit("conversations"))


def llava_ov_single(samples: DataFrame, folder: str) -> DataFrame:
    """samples: id, image (bytes, or null for text) and conversations; the image's path is the id's. No check."""
    path = F.when(F.col("image").isNotNull(), F.concat(F.lit(folder), "id", F.lit(".jpg")))
    return _samples(samples.withColumn("image", path), F.col("id")).drop("id")


def llava_ov_multi(samples: DataFrame, folder: str, valid: DataFrame) -> DataFrame:
    """samples: uid, image (an array of names) and conversations; those of which every image is valid (valid: image, with its folder)."""
    rows = samples.withColumn("image", F.transform("image", lambda x: F.concat(F.lit(folder), x)))
    each = rows.select("uid", F.explode(F.array_distinct("image")).alias("image"))
    bad = each.join(valid, "image", "left_anti").select("uid").distinct()
    return rows.join(bad, "uid", "left_anti").withColumn("data_type", F.lit("conversations"))


def llava_recap(samples: DataFrame, folder: str, valid: DataFrame, templates: list[str]) -> DataFrame:
    """samples: id and conversations; the first turn becomes a template behind <image>. valid: image, with its folder."""
    rows = samples.withColumn("image", F.concat(F.lit(folder), "id", F.lit(".jpg"))).join(valid, "image", "left_semi")
    first = turn_of(F.col("conversations")[0]["from"], F.concat(F.lit("<image>\n"), hash_choice(templates, F.col("id"))))
    rest = F.slice("conversations", F.lit(2), F.size("conversations"))
    return _samples(rows.withColumn("conversations", F.concat(F.array(first), rest)), F.col("id")).drop("id")


def obelics(documents: DataFrame) -> DataFrame:
    """documents: key, caption and image (arrays of slots, one of them null at each place), failed (an image couldn't be stored).

    Documents of two slots or more that begin with an image; a last image goes. Fan out with hygiene.fan_out."""
    rows = documents.where((F.size("image") >= 2) & F.get("image", F.lit(0)).isNotNull() & ~F.col("failed")).drop("failed")
    rows = rows.withColumns({c: without_last_image(F.col(c), F.col("image")) for c in ("caption", "image")})
    return rows.where(admitted(F.col("caption"), F.col("image"))).withColumn("data_type", F.lit("interleave"))
