"""Analysis of multi-sensor recordings of many participants, and preparation of training data, on Spark."""

from .operators.model import PRESETS, Scenario, Settings, preset, run_rounds
from .plans.data import DataConfig, data_config, load_data
from .plans.loso import Predictor, run_fold, run_loso, summarize

__version__ = "0.2.0"
__all__ = ["DataConfig", "PRESETS", "Predictor", "Scenario", "Settings", "__version__", "data_config", "load_data", "preset", "run_fold", "run_loso", "run_rounds", "summarize"]
