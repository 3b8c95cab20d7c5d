"""The retrieval methods, their score and the names of their artifacts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Method:
    key: str
    display: str
    table_stem: str
    index_stem: str
    codebook_stem: str | None
    metric: str


#: Display names, file stems and score of each method, in the order of "all".
METHODS = [
    Method("sift", "SIFT+VLAD", "sift_vlad", "sift_vlad", "sift", "l2"),
    Method("orb", "ORB+BoW", "orb", "orb_bow", "orb", "l2"),
    Method("dinov2", "DINOv2 ViT-S/14", "dinov2", "dinov2", None, "ip"),
    Method("anyloc", "AnyLoc-DINOv2-VLAD", "anyloc_dinov2_vlad", "anyloc_dinov2_vlad", "anyloc_dinov2", "ip"),
    Method("cnn", "CNN (ResNet-50)", "cnn", "cnn", None, "ip"),
]
INDEX_TYPES = ("flat", "ivf", "hnsw")
_BY_KEY = {m.key: m for m in METHODS}
_BOTH = ("sift", "dinov2")


def method(key: str) -> Method:
    try:
        return _BY_KEY[key]
    except KeyError:
        raise ValueError(f"no retrieval method is called {key!r}") from None


def resolve_methods(choice: str) -> list[str]:
    """Keys that a choice stands for: one method, "both" or "all"."""
    return list(_BOTH) if choice == "both" else [m.key for m in METHODS] if choice == "all" else [method(choice).key]


def descriptor_name(key: str) -> str:
    return f"{method(key).table_stem}_descriptors.npy"


def label_name(key: str) -> str:
    return f"{method(key).table_stem}_labels.npy"


def codebook_name(key: str) -> str | None:
    stem = method(key).codebook_stem
    return stem and f"{stem}_codebook.npy"


def index_name(key: str, index_type: str = "flat") -> str:
    """Flat indexes bear the bare name, others their type behind it."""
    return "_".join([method(key).index_stem] + [index_type] * (index_type != "flat")) + ".index"
