"""Operators over normalized event logs; each returns a lazy DataFrame unless it says otherwise."""
