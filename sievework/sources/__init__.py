"""sievework.sources"""
