"""Recognition engines: one protocol, a registry by name, and engines behind it."""

from __future__ import annotations

import base64
import json
import math
import re
import shutil
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import model as M
from vellum.config import Recognition, Vlm
from vellum.kernels import image as I
from vellum.operators import tables as TB
from vellum.sources.images import from_png, png


@dataclass
class Line:
    text: str
    bbox: tuple | None = None
    confidence: float | None = None


@dataclass
class Hints:
    direction: str | None = None
    line_height_px: float | None = None
    n_lines: int | None = None
    page_w: int | None = None


@dataclass
class Result:
    text: str = ""
    html: str | None = None
    confidence: float | None = None
    engine: str = "none"
    lines: list[Line] = field(default_factory=list)
    token_logprobs: list[float] | None = None
    flags: list[str] = field(default_factory=list)
    seconds: float = 0.0


class Engine:
    """What a worker holds: made once, asked crop by crop, closed at the end."""

    def engine_id(self) -> str:
        return type(self).__name__.lower()

    def recognize(self, crop: np.ndarray, region_type: str, hints: Hints) -> Result:
        raise NotImplementedError

    def close(self) -> None:
        return None


class Stub(Engine):
    """Says how dark a crop is; for tests and dry runs."""

    def engine_id(self):
        return "stub"

    def recognize(self, crop, region_type, hints):
        return Result(f"{region_type} {crop.shape[1]}x{crop.shape[0]}", confidence=round(1 - float(I.gray(crop).mean()) / 255, 4), engine=self.engine_id())


def scaled_for_lines(crop: np.ndarray, line_height: float | None) -> tuple[np.ndarray, float]:
    """Grey, lines about 48 pixels high, with a border of twelve."""
    g = I.gray(crop)
    k = min(3.0, max(0.5, 48 / line_height)) if line_height else 1.0
    g = I.resize(g, max(1, round(g.shape[0] * k)), max(1, round(g.shape[1] * k)))
    return np.pad(g, 12, constant_values=255), k


def words_to_lines(rows: list[dict], least: float = 15.0, scale: float = 1.0, border: int = 12) -> Result:
    """Word rows (block, par, line, left, top, width, height, conf, text) as lines from the top down; unsure words are marked."""
    lines: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["text"].strip():
            lines.setdefault((r["block"], r["par"], r["line"]), []).append(r)
    out, total, weight = [], 0.0, 0
    for ws in sorted(lines.values(), key=lambda ws: min(w["top"] for w in ws)):
        text = " ".join(M.UNREADABLE if w["conf"] < least else w["text"].strip() for w in ws)
        box = (min(w["left"] for w in ws), min(w["top"] for w in ws), max(w["left"] + w["width"] for w in ws), max(w["top"] + w["height"] for w in ws))
        out.append(Line(text, tuple((v - border) / scale for v in box), sum(w["conf"] for w in ws) / len(ws) / 100))
        total += sum(w["conf"] / 100 * len(w["text"]) for w in ws)
        weight += sum(len(w["text"]) for w in ws)
    return Result("\n".join(x.text for x in out), confidence=total / weight if weight else 0.0, lines=out)


class Tesseract(Engine):
    """The classic engine, by its command, where it is installed."""

    def __init__(self, cfg: Recognition):
        self.cfg = cfg.tesseract
        self.cmd = self.cfg.cmd or shutil.which("tesseract")
        if not self.cmd:
            raise RuntimeError("tesseract is not installed")

    def engine_id(self):
        return f"tesseract:{self.cfg.langs}"

    def recognize(self, crop, region_type, hints):
        if region_type == "table":
            return self._table(crop, hints)
        return self._read(crop, hints, self.cfg.psm_block)

    def _read(self, crop, hints, psm) -> Result:
        g, k = scaled_for_lines(crop, hints.line_height_px)
        langs = "eng+ara" if hints.direction == "ltr" and self.cfg.langs == "ara+eng" else self.cfg.langs
        tsv = subprocess.run([self.cmd, "stdin", "stdout", "-l", langs, "--psm", str(psm), "tsv"], input=png(g), capture_output=True, check=True, timeout=120).stdout.decode()
        names = tsv.split("\n", 1)[0].split("\t")
        rows = [dict(zip(names, x.split("\t"))) for x in tsv.split("\n")[1:] if x]
        words = [{"block": r["block_num"], "par": r["par_num"], "line": r["line_num"], "text": r.get("text", ""), "conf": float(r["conf"]), **{n: int(r[n]) for n in ("left", "top", "width", "height")}} for r in rows if r["level"] == "5"]
        out = words_to_lines(words, self.cfg.unreadable_word_conf, k)
        out.engine = self.engine_id()
        return out

    def _table(self, crop, hints) -> Result:
        from vellum.kernels.geometry import ruled_grid, with_header_rows

        cells = ruled_grid(crop, hints.direction != "ltr")
        if cells is None:
            r = self._read(crop, hints, self.cfg.psm_block)
            r.confidence, r.flags = (r.confidence or 0) * 0.8, [*r.flags, "no table grid found; read as a block"]
            return r
        cells = with_header_rows(crop, cells)
        h, w = crop.shape[:2]
        n, m = max(c.row + c.rowspan for c in cells), max(c.col + c.colspan for c in cells)
        confs = []
        for c in cells:
            x0 = w - (c.col + c.colspan) * w // m if hints.direction != "ltr" else c.col * w // m
            r = self._read(crop[c.row * h // n : (c.row + c.rowspan) * h // n, x0 : x0 + c.colspan * w // m], hints, self.cfg.psm_block)
            c.text = r.text.replace("\n", " ")
            confs.append(r.confidence or 0.0)
        return Result(html=TB.to_html(cells), confidence=sum(confs) / len(confs), engine=self.engine_id())


def cut_line(ink: np.ndarray, line_h: int, most: float = 12.0) -> list[tuple[int, int]]:
    """Spans of a wide line, each at most `most` line heights, cut at gaps of a fifth of a line height where there are such."""
    w, limit = ink.shape[1], int(most * line_h)
    empty = np.pad((ink > 0).sum(0) == 0, 1)
    edge = np.flatnonzero(np.diff(empty.astype(np.int8)))
    gaps = [(a + b) // 2 for a, b in zip(edge[::2], edge[1::2]) if b - a >= 0.2 * line_h and 0 < a and b < w]
    out, start = [], 0
    while w - start > limit:
        fit = [g for g in gaps if start < g <= start + limit]
        end = fit[-1] if fit else start + limit
        out.append((start, end))
        start = end
    return [*out, (start, w)]


def join_chunks(chunks: pd.DataFrame) -> DataFrame | pd.DataFrame:
    """Chunk rows (line, pos, text, score) as lines: texts joined by spaces, mean scores."""
    return chunks.sort_values(["line", "pos"]).groupby("line", as_index=False).agg(text=("text", " ".join), score=("score", "mean"))


class LineModel(Engine):
    """Chunks of lines through two line readers (right-to-left, left-to-right) that a caller supplies; each maps images to (text, score)."""

    def __init__(self, cfg: Recognition, readers: dict[str, Callable[[list[np.ndarray]], list[tuple[str, float]]]] | None = None):
        if readers is None:
            raise RuntimeError("no line models are installed")
        self.readers = readers

    def engine_id(self):
        return "line-model"

    def recognize(self, crop, region_type, hints):
        rtl = hints.direction != "ltr"
        ink = I.ink_mask(I.gray(crop))
        boxes = sorted(I.text_lines(ink, hints.page_w or crop.shape[1]), key=lambda b: b[1])
        pieces, keys = [], []
        for n, (x0, y0, x1, y1) in enumerate(boxes):
            spans = cut_line(ink[y0:y1, x0:x1], y1 - y0)
            for pos, (a, b) in enumerate(reversed(spans) if rtl else spans):
                pieces.append(crop[y0:y1, x0 + a : x0 + b])
                keys.append((n, pos))
        read = []
        for k in range(0, len(pieces), 8):
            read += self.readers["rtl" if rtl else "ltr"](pieces[k : k + 8])
        if not read:
            return Result(confidence=0.0, engine=self.engine_id())
        lines = join_chunks(pd.DataFrame([(*k, t, s) for k, (t, s) in zip(keys, read)], columns=["line", "pos", "text", "score"]))
        n = max(1, sum(len(t) for t, _ in read))
        return Result("\n".join(lines.text), confidence=sum(s * len(t) for t, s in read) / n, engine=self.engine_id(), lines=[Line(t, boxes[i], s) for i, t, s in lines.itertuples(index=False)])


def encoded(crop: np.ndarray, most: int) -> str:
    """PNG as base64, within `most` pixels and at least 48 on the shorter side."""
    img, _ = I.fitted(crop, most)
    h, w = img.shape[:2]
    if min(h, w) < 48:
        k = 48 / min(h, w)
        img = I.resize(img, max(1, round(h * k)), max(1, round(w * k)))
    return base64.b64encode(png(img)).decode()


def logprob_confidence(lps: list[float] | None) -> float | None:
    if not lps:
        return None
    weak = sum(x < math.log(0.5) for x in lps) / len(lps)
    return min(1.0, max(0.0, math.exp(sum(lps) / len(lps)) - 0.5 * weak))


def cleaned(raw: str, region_type: str) -> tuple[str, list[str]]:
    """Python twin of functions.text.cleaned_output, for engines that run inside of a worker."""
    s = re.sub(r"\n?```\s*$", "", re.sub(r"^```[A-Za-z]*[ \t]*\n?", "", raw.strip())).strip()
    flags = []
    if region_type == "table":
        m = re.search(r"(?is)<table.*?</table>", s)
        flags += [] if m else ["no_html_table"]
        s = m.group() if m else s
    s = re.sub(M.BIDI_CONTROLS, "", s).strip()
    if region_type != "table" and (m := re.search(r"(?s)(.{6,40}?)(?:\s*\1){3,}", s)):
        s, flags = (s[: m.start()] + m.group(1)).strip(), [*flags, "repetition_truncated"]
    return s, flags


class ChatVlm(Engine):
    """A vision-language model behind an HTTP chat-completions interface."""

    def __init__(self, cfg: Recognition):
        self.cfg: Vlm = cfg.vlm

    def engine_id(self):
        return f"vlm:{self.cfg.model}"

    def health(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.cfg.base_url}/models", timeout=5) as r:
                return r.status == 200
        except OSError:
            return False

    def budget(self, crop: np.ndarray, region_type: str, line_h: float | None) -> int:
        h, w = crop.shape[:2]
        lh = line_h or 40.0
        n = max(1.0, h / (1.25 * lh)) * max(4.0, w / (0.45 * lh)) * 0.55 * self.cfg.tokens_per_line_factor * (3 if region_type == "table" else 1) + 16
        return int(min(max(n, self.cfg.min_tokens), self.cfg.max_tokens))

    def adapter(self, region_type: str) -> str | None:
        return self.cfg.adapters.get(region_type) or self.cfg.adapters.get("handwritten" if region_type == "handwritten_note" else "printed")

    def _ask(self, body: dict) -> dict:
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.cfg.api_key}"} if self.cfg.api_key else {})}
        with urllib.request.urlopen(urllib.request.Request(f"{self.cfg.base_url}/chat/completions", json.dumps(body).encode(), head), timeout=self.cfg.timeout_s) as r:
            return json.load(r)

    def recognize(self, crop, region_type, hints):
        image = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + encoded(crop, self.cfg.max_image_side)}}
        body = {
            "model": self.adapter(region_type) or self.cfg.model, "temperature": self.cfg.temperature, "max_tokens": self.budget(crop, region_type, hints.line_height_px),
            "messages": [{"role": "user", "content": [image, {"type": "text", "text": M.PROMPTS.get(region_type, M.PROMPTS["text"])}]}], "logprobs": self.cfg.request_logprobs,
        }
        try:
            got = self._ask(body)
        except urllib.error.HTTPError:
            got = self._ask({k: v for k, v in body.items() if k != "logprobs"})  # servers that know no logprobs
        choice = got["choices"][0]
        lps = [x["logprob"] for x in ((choice.get("logprobs") or {}).get("content") or [])] or None
        text, flags = cleaned(choice["message"]["content"] or "", region_type)
        conf = logprob_confidence(lps)
        if conf is None:
            conf, flags = 0.7, [*flags, "no token logprobs"]
        if choice.get("finish_reason") == "length":
            flags.append("output cut at the token limit")
        if [f for f in flags if f != "no token logprobs"]:
            conf *= 0.7
        table = region_type == "table" and "no_html_table" not in flags
        return Result("" if table else text, TB.sanitized(text) if table else None, conf, self.engine_id(), token_logprobs=lps, flags=flags)


class LocalVlm(ChatVlm):
    """The same model in this process, through the transformers library where that is installed; a loader may be handed in."""

    def __init__(self, cfg: Recognition, load: Callable | None = None):
        super().__init__(cfg)
        self.model, self.processor = (load or self._load)(cfg.vlm)

    def _load(self, cfg: Vlm):
        import torch
        from transformers import AutoModelForImageTextToText, AutoProcessor, BitsAndBytesConfig

        how = {"torch_dtype": getattr(torch, cfg.dtype, "auto"), "device_map": "auto"}
        if cfg.load_in_4bit:
            how["quantization_config"] = BitsAndBytesConfig(load_in_4bit=True)
        path = cfg.model_path or cfg.model
        model = AutoModelForImageTextToText.from_pretrained(path, **how)
        for name, adapter in cfg.adapters.items():
            model.load_adapter(adapter, adapter_name=name)
        return model, AutoProcessor.from_pretrained(path)

    def engine_id(self):
        return f"local:{self.cfg.model_path or self.cfg.model}"

    def _ask(self, body: dict) -> dict:
        """A chat answer in the shape of the HTTP one, with the log-probability of each token that was chosen."""
        image, text = body["messages"][0]["content"]
        if body["model"] in self.cfg.adapters and hasattr(self.model, "set_adapter"):
            self.model.set_adapter(body["model"])
        chat = [{"role": "user", "content": [{"type": "image", "image": image["image_url"]["url"]}, text]}]
        inputs = self.processor.apply_chat_template(chat, add_generation_prompt=True, tokenize=True, return_dict=True, return_tensors="pt").to(self.model.device)
        got = self.model.generate(**inputs, max_new_tokens=body["max_tokens"], do_sample=False, output_scores=True, return_dict_in_generate=True)
        new = got.sequences[0][inputs["input_ids"].shape[1] :]
        lps = self.model.compute_transition_scores(got.sequences, got.scores, normalize_logits=True)[0].tolist()
        full = len(new) >= body["max_tokens"]
        return {"choices": [{"message": {"content": self.processor.decode(new, skip_special_tokens=True)}, "logprobs": {"content": [{"logprob": x} for x in lps]}, "finish_reason": "length" if full else "stop"}]}


def build_vlm(cfg: Recognition) -> Engine:
    """The vision-language engine of the settings' backend."""
    return LocalVlm(cfg) if cfg.vlm.backend in ("transformers", "local") else ChatVlm(cfg)


REGISTRY: dict[str, Callable[[Recognition], Engine] | None] = {"stub": lambda cfg: Stub(), "tesseract": Tesseract, "paddle": LineModel, "vlm": build_vlm, "none": None}


def make(name: str, cfg: Recognition = Recognition()) -> Engine | None:
    if name not in REGISTRY:
        raise ValueError(f"unknown engine {name!r}")
    build = REGISTRY[name]
    return build(cfg) if build else None


RESULT = f"text string, html string, confidence double, engine string, token_logprobs array<double>, flags array<string>, seconds double, lines array<struct<text:string,bbox:{M.BOX},confidence:double>>"


def recognized(crops: DataFrame, engine: str, cfg: Recognition = Recognition(), keys: tuple = ("doc_id", "block_id")) -> DataFrame:
    """Results of an engine for crops (keys, type, image as PNG, direction, line_height_px, page_w). One engine per task; an engine that fails is a flag, never a failed job."""
    types = ", ".join(f"`{k}` {crops.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(x.strip().split(" ")[0] for x in "text, html, confidence, engine, token_logprobs, flags, seconds, lines".split(","))]

    def run(frames: Iterable[pd.DataFrame]):
        import time

        try:
            it, broken = make(engine, cfg), None
        except Exception as e:  # noqa: BLE001  an engine that is not installed
            it, broken = None, f"{engine} unavailable: {e}"
        try:
            for f in frames:
                out = []
                for r in f.itertuples():
                    t, res = time.monotonic(), None
                    try:
                        res = it.recognize(from_png(r.image), r.type, Hints(r.direction, r.line_height_px, None, int(r.page_w))) if it else None
                        note = [broken] if broken else []
                    except Exception as e:  # noqa: BLE001  one crop must not end the batch
                        note = [f"{engine} failed: {type(e).__name__}"]
                    res = res or Result(confidence=None, engine="none")
                    lines = [{"text": x.text, "bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, x.bbox))) if x.bbox else None, "confidence": x.confidence} for x in res.lines]
                    out.append([*(getattr(r, k) for k in keys), res.text, res.html, res.confidence, res.engine, res.token_logprobs, [*res.flags, *note], time.monotonic() - t, lines])
                yield pd.DataFrame(out, columns=names, dtype=object)
        finally:
            if it:
                it.close()

    return crops.mapInPandas(run, f"{types}, {RESULT}")


def routed(blocks: DataFrame, cfg: Recognition = Recognition()) -> DataFrame:
    """The engine for each block, by its type."""
    by = F.create_map(*(F.lit(x) for kv in cfg.primary_by_type.items() for x in kv)) if cfg.primary_by_type else None
    return blocks.withColumn("p_name", F.coalesce(F.element_at(by, F.col("type")), F.lit(cfg.primary)) if by is not None else F.lit(cfg.primary))
