"""Reading tables, flattening nested data, standardising dates, and writing."""
