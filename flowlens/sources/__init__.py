"""Readers: driver tables, the events->packets adapter, pcap files, CSV and text logs."""
