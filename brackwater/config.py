"""Settings of the processing levels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentConfig:
    """Lengths and overlaps are in samples: a segment is an FFT window, a chunk gives one estimate."""

    sampfreq: float
    segment_length: int
    segment_overlap: int
    chunk_length: int
    chunk_overlap: int

    @property
    def number_fft_windows_per_chunk(self) -> int:
        """Segments that fit in a chunk."""
        return (self.chunk_length - self.segment_length) // (self.segment_length - self.segment_overlap) + 1


@dataclass(frozen=True)
class ShearConfig(SegmentConfig):
    freq_cutoff_antialias: float | None = None
    freq_cutoff_corrupt: float | None = None
    freq_highpass: float = 0.15
    spatial_response_wavenum: float = 50.0
    waveno_cutoff_spatial_corr: float | None = None
    waveno_spectral_min: float | None = None
    spike_threshold: float = 8.0
    max_tries: int = 10
    spike_replace_before: int = 512
    spike_replace_after: int = 512
    spike_include_before: int = 10
    spike_include_after: int = 20
    cutoff_freq_lp: float = 0.5
    molvisc_fallback: float = 1.6e-6

    @property
    def log_psi_var(self) -> float:
        """Variance of the logarithm of a spectral estimate: 5/4 N^(-7/9) for N windows."""
        return 1.25 * self.number_fft_windows_per_chunk ** (-7 / 9)


@dataclass(frozen=True)
class UTempConfig(SegmentConfig):
    diff_gain: float = 1.5
    waveno_limit_upper: float = 500.0
