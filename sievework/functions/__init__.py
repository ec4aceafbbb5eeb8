"""sievework.functions"""
