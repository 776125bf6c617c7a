"""Microstructure analytics on Spark."""

from .config import SegmentConfig, ShearConfig, UTempConfig
from .logs import get_logger, set_loglevel
from .operators.mss import MssDevice, MssSensor, mrd_to_level1
from .plans.pipeline import ShearPipeline, TemperaturePipeline, subset
from .variables import VARIABLES, describe

__version__ = "0.2.0"
__all__ = [
    "VARIABLES", "MssDevice", "MssSensor", "SegmentConfig", "ShearConfig", "ShearPipeline", "TemperaturePipeline", "UTempConfig", "describe", "get_logger", "mrd_to_level1", "set_loglevel", "subset",
]
