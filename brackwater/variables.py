"""Names and units of the quantities that tables carry, as metadata of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names of the community's conventions and units.
VARIABLES: dict[str, dict[str, str]] = {
    "cond": {"standard_name": "sea_water_conductivity"},
    "eps": {"atomix_name": "EPSI", "standard_name": "specific_turbulent_kinetic_energy_dissipation_in_sea_water", "unit": "W kg-1", "latex": r"$\eps$"},
    "freq": {"unit": "Hz", "explanation": "Cycles in a second"},
    "kolmlen": {"latex": r"$\eta$", "explanation": "Length of Kolmogorov's scale"},
    "molvisc": {"long_name": "molecular_viscosity_of_seawater", "unit": "m2 s-1"},
    "press": {"standard_name": "sea_water_pressure", "explanation": "Pressure in the sea"},
    "psi": {"explanation": "A power spectrum over frequency or wavenumber"},
    "psi_f": {"explanation": "A power spectrum per Hz"},
    "psi_f_gradt": {"unit": "K2 m-2 Hz-1", "long_name": "", "latex": r"\Psi_{Tz}", "explanation": "Spectrum of the temperature gradient over frequency"},
    "psi_f_sh": {"atomix_name": "SPEC", "unit": "s-2 Hz-1", "long_name": "", "explanation": "Spectrum of shear over frequency"},
    "psi_k": {"explanation": "A power spectrum per cpm"},
    "psi_k_gradt": {"unit": "K2 m-2 cpm-1", "long_name": "", "latex": r"\Psi_{Tz}", "explanation": "Spectrum of the temperature gradient over wavenumber"},
    "psi_k_sh": {"atomix_name": "SPEC", "unit": "s-2 cpm-1", "long_name": "", "explanation": "Spectrum of shear over wavenumber"},
    "sal": {"standard_name": "sea_water_salinity"},
    "sampfreq": {"atomix_name": "fs", "unit": "Hz", "explanation": "Samples in a second"},
    "senspeed": {"atomix_name": "PSPD", "unit": "m s-1", "long_name": "Platform speed through water", "explanation": "How fast the sensor moves through water"},
    "shear": {"atomix_name": "SH", "unit": "s-1", "explanation": "Shear of the current"},
    "temp": {"standard_name": "sea_water_temperature", "unit": "degC"},
    "waveno": {"atomix_name": "KCYC", "unit": "cpm", "explanation": "Cycles in a metre"},
    "x": {"explanation": "Any signal"},
}


def describe(df: DataFrame) -> DataFrame:
    """df with its known columns' attributes as metadata, which Parquet keeps."""
    for c in df.columns:
        if c in VARIABLES:
            df = df.withMetadata(c, VARIABLES[c])
    return df
