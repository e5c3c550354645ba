"""Operators over frames: filters, counters, ordered statistics, places, absences and habits."""
