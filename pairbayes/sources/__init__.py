"""Sources and sinks: tables, CSV, spectra text, catalogues, model store."""
