"""Sources and sinks: labelled image folders, split tables, nested records, JSON documents."""
