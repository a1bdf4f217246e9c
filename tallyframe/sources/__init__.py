"""Sources and sinks: delimited files, SQL, run listings, reports, id lists."""
