"""Photometry, catalog, time-series, pixel and linking operators (DataFrame in, DataFrame out)."""
