"""Tree, layout, device-table, integrity and report operators over DataFrames."""
