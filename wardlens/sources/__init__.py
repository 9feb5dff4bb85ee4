"""Sources and sinks: warehouse tables, CSV registries, report sinks."""
