"""Factor catalog and the jobs that evaluate it."""

from .catalog import (
    CATALOG,
    dependency_class,
    executable,
    factor_frame,
    factor_long,
    metadata_frame,
    register,
    required_datasets,
    split_factor_frame,
)
from .model import Factor

__all__ = [
    "CATALOG", "Factor", "dependency_class", "executable", "factor_frame", "factor_long",
    "metadata_frame", "register", "required_datasets",
    "split_factor_frame",
]
