"""Writers: table replacement and merge, report exports."""
