"""Reading tables and CSV files, writing reports."""
