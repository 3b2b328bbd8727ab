"""Writers: tables, prediction cache, reports."""
