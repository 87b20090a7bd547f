"""Checks of how a run was made: equal settings, frozen artifacts, completions, prompt sizes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of the chat template around a prompt, where no template is at hand to count them.
TEMPLATE_TOKENS = 16


def setting_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(run, setting, value) twice -> run, setting, wanted, value of settings that differ or are
    missing. A null equals a null only; settings that nobody expects are legal."""
    e, f = expected.alias("e"), found.alias("f")
    both = e.join(f, (F.col("e.run") == F.col("f.run")) & (F.col("e.setting") == F.col("f.setting")), "left")
    return both.where(~F.col("e.value").eqNullSafe(F.col("f.value")) | F.col("f.setting").isNull()).select("e.run", "e.setting", F.col("e.value").alias("wanted"), F.col("f.value").alias("value"))


def flattened(document: Mapping, prefix: str = "") -> dict[str, str | None]:
    """The settings of a nested document by dotted name, each as text, for ``setting_faults``."""
    out: dict[str, str | None] = {}
    for name, value in document.items():
        if isinstance(value, Mapping):
            out |= flattened(value, f"{prefix}{name}.")
        else:
            out[f"{prefix}{name}"] = None if value is None else str(value)
    return out


def completion_fault(stop: Column, truncated: Column, content: Column, tokens: Column, eos: int) -> Column:
    """Why a completion is not usable; null if it is."""
    return (
        F.when(F.coalesce(truncated, F.lit(False)), "truncated")
        .when(~F.coalesce(stop.isin("eos", "limit"), F.lit(False)), "stop type")
        .when(content.isNull(), "content")
        .when(F.coalesce(F.size(tokens), F.lit(0)) < 1, "tokens")
        .when(F.exists(tokens, lambda t: t.isNull()), "tokens")
        .when((stop == "eos") & (F.element_at(tokens, -1) != eos), "last token")
    )


def prompt_overhead(count: Callable[[str], int], prompt: str, rendered: Callable[[list[dict]], str] | None = None) -> int:
    """Tokens that a chat spends before and after its text: those of the template around a
    system prompt and two empty turns, or of the prompt and TEMPLATE_TOKENS without a template."""
    if rendered is None:
        return count(prompt) + TEMPLATE_TOKENS
    return count(rendered([{"role": "system", "content": prompt}, {"role": "user", "content": ""}, {"role": "assistant", "content": ""}]))


# What a training configuration must say, and the switches that must be on.

REQUIRED_SETTINGS = ["model", "data", "train", "fine_tune_type", "adapter_path", "iters", "max_seq_length", "mask_prompt"]
SWITCHES = ["train", "mask_prompt"]


def training_faults(config: Mapping, root: Path, splits: tuple[str, ...] = ("train", "valid", "test")) -> list[str]:
    """What keeps a training run from starting: settings that are missing or off, inputs that are
    not there, and an output folder that holds something."""
    missing = [name for name in REQUIRED_SETTINGS if name not in config]
    if missing:
        return [f"missing: {name}" for name in missing]
    out = [f"off: {name}" for name in SWITCHES if config[name] is not True]
    if not (root / config["model"]).is_dir():
        out.append("model")
    out += [f"data: {split}" for split in splits if not (root / config["data"] / f"{split}.jsonl").is_file()]
    target = root / config["adapter_path"]
    if target.exists() and any(target.iterdir()):
        out.append("adapter_path")
    return out
