"""Lake layout: layer paths, asset paths, checkpoint paths (S5, S6, X2) and path templates (S3)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

# Layers of the lake.
LAYERS = ("bronze", "silver", "gold", "sandbox")


@dataclass(frozen=True)
class LakeLayout:
    """Where each layer lives.  ``base`` is a URI prefix (``abfss://…``, ``s3a://…``, a path)."""

    base: str
    environment: str = "dev"

    def path(self, layer: str, name: str) -> str:
        """``{base}/{layer}/{name}``; checkpoints and code have their own roots; the sandbox
        layer is refused in production."""
        layer = layer.lower()
        if layer == "sandbox" and self.environment == "prod":
            raise ValueError("the sandbox layer is not available in production")
        if layer not in LAYERS + ("checkpoint", "code"):
            raise ValueError(f"unknown layer {layer!r}")
        root = {"checkpoint": "_checkpoints", "code": "_code"}.get(layer, layer)
        return f"{self.base.rstrip('/')}/{root}/{name.strip('/')}"

    def asset(self, layer: str, category: str, entity: str, audience: str, cohort: str, asset: str,
              version: int, name: str) -> str:
        """``category/entity/audience/cohort/asset/v{N}/name`` under the layer."""
        parts = [category, entity, audience, cohort, asset, f"v{int(version)}", name]
        return self.path(layer, "/".join(p.strip("/") for p in parts))

    def checkpoint(self, pipeline: str) -> str:
        """One streaming checkpoint folder per pipeline."""
        return self.path("checkpoint", re.sub(r"[^A-Za-z0-9_.-]", "_", pipeline))


def render_path(template: str, slot: datetime, hour: int | None = None) -> str:
    """S3: fill ``{_year}``, ``{_month}``, ``{_day}``, ``{PARTITION_HOUR}`` / ``{_hour}`` as plain
    integers (a format spec such as ``{_month:02d}`` pads); other braces and globs stay."""
    values = {"_year": slot.year, "_month": slot.month, "_day": slot.day,
              "_hour": slot.hour if hour is None else hour, "PARTITION_HOUR": slot.hour if hour is None else hour,
              "PARTITION_DATE": slot.strftime("%Y-%m-%d")}

    def fill(m: re.Match) -> str:
        name, spec = m.group(1), m.group(2) or ""
        if name not in values:
            return m.group(0)
        return format(values[name], spec)

    return re.sub(r"\{([A-Za-z_]+)(?::([^{}]*))?\}", fill, template)
