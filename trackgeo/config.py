"""Parameters with their default values, and parameter sweeps as one job."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Instrument geometry and windows of the data set.
X_START_MM, X_STOP_MM = 20.0, 100.0
MM_PER_FRAME = 0.2
KEPT_FRAMES = 400
CORRIDOR_MM = (0.65, 1.35)
THRESHOLD_SETS = {
    "FULL": [1.5, 2.0, 2.5, 3.0, 3.5],
    "REMOVE_LOW": [2.0, 2.5, 3.0, 3.5],
    "REMOVE_HIGH": [1.5, 2.0, 2.5, 3.0],
    "INNER": [2.0, 2.5, 3.0],
}
SEPARATION_EDGES_MM = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 100.0]
THERMAL_FEATURES = ["peak_temp", "sqrt_mp_area", "mp_length"]
SEM_FEATURES = ["substrate_roughness_variance", "substrate_mean_intensity"]

# Target groups of the final table, each with the columns that tell whether its targets are usable.
_SCALAR_VALIDITY = [
    "eligible", "is_within_heightmap_x_coverage", "central_corridor_finite_fraction", "finite_fraction",
    "baseline_support_count", "fallback_baseline_required", "_descriptor_matched"]
TARGET_GROUPS = {
    "pca_shape": (["pc1", "pc2", "pc3", "pc4", "pc5"], [
        "eligible", "nonflat", "pca_ready", "normalization_status", "shape_support_fraction_on_common_grid",
        "retained_pca_grid_finite_fraction", "_descriptor_matched"]),
    "amplitude": (["amplitude_um"], _SCALAR_VALIDITY),
    "signed_elevation": (["signed_elevation_um"], _SCALAR_VALIDITY),
    "smoothed_macro_width": (["smoothed_macro_width_mm"], ["eligible", "is_within_heightmap_x_coverage"]),
}
ROW_IDENTITY = ["track_id", "frame_index", "x_position_mm"]


def feature_groups(
    thermal: list[str] | None = None, sem: list[str] | None = None
) -> dict[str, list[str]]:
    """Feature-group ablation: each modality alone and both together."""
    t = THERMAL_FEATURES if thermal is None else thermal
    s = SEM_FEATURES if sem is None else sem
    return {"thermal": t, "sem": s, "thermal_sem": [*t, *s]}


@dataclass(frozen=True)
class Extraction:
    """Parameters of one cross-section extraction."""

    config_name: str = "CONTROL"
    exclusion_lo: float = 0.65
    exclusion_hi: float = 1.35
    prior_lo: float = 0.65
    prior_hi: float = 1.35
    threshold_k: float = 2.5
    min_spread: float = 0.75
    min_baseline: int = 30
    smooth_window: int = 9
    min_run: int = 15
    min_samples: int = 6
    min_width: float = 0.035
    max_width: float = 1.10
    height_weight: float = 2.0
    width_weight: float = 1.0
    centre_weight: float = 1.5
    continuity_weight: float = 0.6
    width_mode: str = "gaussian"
    preferred_width: float = 0.32
    width_scale: float = 0.30
    width_lo: float = 0.10
    width_hi: float = 0.80
    width_taper: float = 0.40
    continuity_scale: float = 0.18
    min_score: float = 1.0
    ambiguity_ratio: float = 0.85
    edge_margin: float = 0.08
    edge_strength: float = 50.0


CONTROL = Extraction()


def variants(base: Extraction, overrides: dict[str, dict]) -> list[Extraction]:
    """Named copies of `base` with some parameters replaced; the base comes first."""
    return [base, *[replace(base, config_name=name, **changes) for name, changes in overrides.items()]]


def sweep(df: DataFrame, configs: list[Extraction], names: list[str] | None = None) -> DataFrame:
    """Every row once per configuration, with the parameters as columns.

    The configurations are literals of the plan; nothing is joined.
    """
    wanted = names or [f.name for f in fields(Extraction)]
    literals = [
        F.struct(*[F.lit(asdict(c)[n]).alias(n) for n in wanted]) for c in configs
    ]
    return df.withColumn("_cfg", F.explode(F.array(*literals))).select("*", "_cfg.*").drop("_cfg")
