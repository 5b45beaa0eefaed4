"""Sources and sinks on files, as Spark readers and writers: exports (exports), feeds (feeds), the lake and its tables (lake)."""
