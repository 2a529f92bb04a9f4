"""Settings as frozen records; a profile, a file and overrides are merged in that order."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import shutil
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Runtime:
    device: str = "auto"
    max_image_side: int = 5000
    paddlex_cache: str | None = None
    offline: bool = True


@dataclass(frozen=True)
class Qa:
    min_blur_var: float = 60.0
    min_long_side_px: int = 1500
    max_glare_ratio: float = 0.02
    min_coverage: float = 0.25


@dataclass(frozen=True)
class Geometry:
    detect_boundary: bool = True
    min_doc_area_ratio: float = 0.20
    dewarp: str = "none"
    orientation: str = "paddle"
    deskew: bool = True
    max_deskew_deg: float = 8.0
    target_long_side_px: int = 2400


@dataclass(frozen=True)
class Illumination:
    enabled: bool = True
    kernel_frac: float = 0.035


@dataclass(frozen=True)
class Layout:
    backend: str = "paddle"
    model_name: str = "PP-DocLayout_plus-L"
    model_dir: str | None = None
    threshold: float = 0.35
    fill_uncovered_text: bool = True
    detect_ink_colors: bool = True


@dataclass(frozen=True)
class Classic:
    cmd: str | None = None
    tessdata_dir: str | None = None
    langs: str = "ara+eng"
    psm_block: int = 6
    psm_line: int = 7
    unreadable_word_conf: float = 15.0


@dataclass(frozen=True)
class LineModel:
    rec_model_ar: str = "arabic"
    rec_model_en: str = "latin"
    model_root: str | None = None
    enable_mkldnn: bool = False


@dataclass(frozen=True)
class Vlm:
    backend: str = "openai"
    base_url: str = "http://127.0.0.1:8080/v1"
    api_key: str = ""
    model: str = "local"
    model_path: str | None = None
    dtype: str = "auto"
    load_in_4bit: bool = False
    adapters: dict = field(default_factory=dict)
    timeout_s: float = 300.0
    temperature: float = 0.0
    min_tokens: int = 32
    max_tokens: int = 2048
    tokens_per_line_factor: float = 1.6
    max_image_side: int = 1280
    request_logprobs: bool = True


@dataclass(frozen=True)
class Recognition:
    primary: str = "tesseract"
    secondary: str = "paddle"
    primary_by_type: dict = field(default_factory=dict)
    ocr_stamps_to_metadata: bool = True
    numeric_prefer_classic: bool = True
    tesseract: Classic = field(default_factory=Classic)
    paddle: LineModel = field(default_factory=LineModel)
    vlm: Vlm = field(default_factory=Vlm)


@dataclass(frozen=True)
class Confidence:
    w_engine: float = 0.6
    w_agreement: float = 0.4
    handwritten_penalty: float = 0.15
    block_review_threshold: float = 0.75
    page_review_threshold: float = 0.85
    agreement_ignore_digits_for: tuple = ("paddle",)


@dataclass(frozen=True)
class Docx:
    font_latin: str = "Calibri"
    font_arabic: str = "Arial"
    default_size_pt: float = 13.0
    min_size_pt: float = 8.0
    max_size_pt: float = 28.0
    font_size_from_line_height: bool = True
    highlight_low_confidence: bool = True
    comment_low_confidence: bool = True
    low_confidence_threshold: float = 0.75
    insert_images: bool = True
    stamp_floating: bool = True
    line_height_to_pt_ar: float = 0.86
    line_height_to_pt_latin: float = 1.0


@dataclass(frozen=True)
class Config:
    profile: str = "dev-cpu"
    runtime: Runtime = field(default_factory=Runtime)
    qa: Qa = field(default_factory=Qa)
    geometry: Geometry = field(default_factory=Geometry)
    illumination: Illumination = field(default_factory=Illumination)
    layout: Layout = field(default_factory=Layout)
    recognition: Recognition = field(default_factory=Recognition)
    confidence: Confidence = field(default_factory=Confidence)
    docx: Docx = field(default_factory=Docx)

    def digest(self) -> str:
        """First 12 hex digits of the SHA-256 of the settings as JSON with sorted keys."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:12]


# The profiles' names, models and addresses.
PROFILES: dict[str, dict] = {
    "dev-cpu": {},
    "dev-vlm": {
        "recognition": {
            "primary": "vlm", "secondary": "tesseract", "primary_by_type": {"table": "tesseract"},
            "vlm": {"backend": "openai", "base_url": "http://localhost:11434/v1", "model": "qwen3-vl:2b-instruct-q4_K_M"},
        },
    },
    "gpu-server": {
        "runtime": {"device": "cuda"}, "geometry": {"dewarp": "uvdoc"},
        "recognition": {"primary": "vlm", "secondary": "paddle", "vlm": {"backend": "openai", "base_url": "http://localhost:8000/v1", "model": "Qwen/Qwen3-VL-8B-Instruct", "max_image_side": 1600}},
    },
}


def resolve_device(device: str, probe=shutil.which) -> str:
    """What "auto" stands for here: cuda where the driver's tool is found, else cpu; any other name is taken as it is."""
    return ("cuda" if probe("nvidia-smi") else "cpu") if device == "auto" else device


def merged(base: dict, over: dict) -> dict:
    """Maps are merged key by key; any other value on the right replaces the left one."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def _build(kind, values: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for name, v in values.items():
        d = known[name].default_factory() if known[name].default_factory is not dataclasses.MISSING else None
        out[name] = _build(type(d), v) if dataclasses.is_dataclass(d) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return kind(**out)


def load(path: str | os.PathLike | None = None, profile: str | None = None, overrides: dict | None = None) -> Config:
    """A JSON file, or a YAML one where a YAML parser is installed; the profile's name is the argument's, else the file's, else dev-cpu."""
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        try:
            values = json.loads(raw)
        except json.JSONDecodeError:
            import yaml  # optional

            values = yaml.safe_load(raw) or {}
    name = profile or values.get("profile") or "dev-cpu"
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}")
    return _build(Config, merged(merged(PROFILES[name], values), {**(overrides or {}), "profile": name}))
